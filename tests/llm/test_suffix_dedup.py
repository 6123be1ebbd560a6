import hashlib
import random
from collections import Counter

import numpy as np

from loomgraph.llm import queries, suffix_dedup


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, "i4")
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0 if t else np.zeros(0, bool)
        spans = int((np.diff(np.concatenate([[0], gone.astype("i1")])) == 1).sum())
        kept = bytes(np.frombuffer(t, "u1")[~gone]) if t else b""
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 3, 250):
        regions = [rng.integers(0 if letters == 2 else 97, 97 + letters if letters < 200 else 256, rng.integers(200, 420)).astype("u1").tobytes() for _ in range(12)]
        regions += [regions[0], regions[1][:250], b"ab" * 150, b"a" * 230, b"b" * 300 + b"a"]
        counts = np.array([len(r) - 199 for r in regions])
        text = np.frombuffer(b"".join([*regions, bytes(200)]) + b"\xff" * 8, "u1")
        starts = np.concatenate([[0], np.cumsum([len(r) for r in regions])[:-1]])
        order = suffix_dedup.sorted_windows(text, starts, counts)
        assert sorted(order.tolist()) == sorted(k for s, n in zip(starts.tolist(), counts.tolist()) for k in range(s, s + n))
        strings = [text[k : k + 200].tobytes() for k in order.tolist()]
        assert strings == sorted(strings)
        assert suffix_dedup.common_prefixes(text, order).tolist() == [a == b for a, b in zip(strings, strings[1:])]


def made_up():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(30, 120)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "ab" * 300), (7, "ab" * 130 + "c"), (8, prose(40) * 3), (None, prose(90)), (9, "\x00" * 300 + prose(20))]
    for k in range(10, 90):
        body = prose(rng.randint(0, 150)).split(" ")
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randint(0, 40)
            body.insert(rng.randint(0, len(body)), p[a : len(p) - rng.randint(0, 40)])
        rows.append((k, " ".join(body)))
    base = prose(400)
    for k in range(100, 130):  # near copies
        w = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    return rows + [(10, rows[10][1]), (200, rows[12][1])]


def test_against_brute_force(spark):
    rows = made_up()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    for n in (1, 5):
        got = suffix_dedup.digests(docs.repartition(n)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert suffix_dedup.digests(docs.limit(0)).count() == 0
    kept = suffix_dedup.without_repeats(docs.repartition(3))
    assert kept.columns == docs.columns
    want = {i: h for i, _, gone, _, h in brute(rows) if not gone}
    for r in kept.collect():
        if r["doc_id"] in want and r["text"] is not None:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]]
    assert [r["text"] for r in kept.where("doc_id = 1").collect()] == [None]


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    rows = made_up()[40:100]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.digests(docs).collect()), key=str) == brute(rows)


def test_hot_anchors(spark, monkeypatch):
    """Anchors with many different regions come as single windows; in some tasks such an anchor has only one region."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage = prose(80)
    rows = [(k, f"{prose(30)} {passage} {prose(30)}") for k in range(40)] + made_up()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for hot, local, n in ((2, 64, 3), (8, 64, 12), (0, 64, 1), (1000, 4, 3), (3, 1, 40)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "LOCAL", local)
        monkeypatch.setattr(suffix_dedup, "MOST_FOLDERS", 2 if n == 12 else 4096)
        texts, folders = suffix_dedup.marked(docs.repartition(n))
        named = [len(suffix_dedup._asked(folders["hot"], k, suffix_dedup.NO_ANCHORS.dtype)) for k in range(n)]
        assert sum(named) > 0
        assert sorted(map(tuple, suffix_dedup.digests(docs.repartition(n)).collect()), key=str) == want


def test_sf(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op9_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)
