import itertools
import random

import numpy as np
from xxhash import xxh64_intdigest

from loomgraph.llm import queries, simhash

WHITE = "\t\n\x0b\f\r "


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    a = np.array(fps, "u8")
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 2):
            x, y = sorted((find(i), find(int(j))))
            root[y] = x
    best = {}
    for k, d in enumerate(ids):
        r = find(k)
        if d is not None:
            best[r] = min(d, best.get(r, d))
    return [best.get(find(k)) for k in range(len(ids))]


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        ms = simhash.masks(radius)
        assert len(ms) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(0, 64, 3 if radius == 3 else 1), radius):
            assert any(all(not m >> b & 1 for b in bits) for m in ms)


def test_fingerprints():
    for t in ["", None, "One", "a B", "a b c\x0bd e\x1cf", "É x Y z " * 50, "w " * 70000]:
        assert simhash.fingerprint(t) == plain(t)


def test_sf(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    fps = [plain(r["text"]) for r in rows]
    want = brute_components([r["doc_id"] for r in rows], fps)
    assert got == {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want)}
    assert len({c for _, c in got.values()}) < len(got)


def test_chains_and_crowds(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(50)]
    x = fps[0]
    for _ in range(40):  # a long chain
        x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        fps.append(x)
    fps += [fps[1] ^ 1 << rng.randrange(36) ^ 1 << rng.randrange(36) for _ in range(300)]  # a crowded bucket
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links_within_two(df)).collect()}
    want = brute_components([simhash.signed(f) for f in fps], fps)
    assert [got.get(simhash.signed(f), simhash.signed(f)) for f in fps] == want


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (None, " \n", 1), (9, "a b c d", 1), (9, "a b c d", 1), (None, "q r s t u", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 9), (9, 9), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
