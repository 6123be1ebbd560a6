import random
import tracemalloc
import zlib

import numpy as np

from loomgraph.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_table_equals_kernel_by_definition():
    rng = np.random.default_rng(0)
    words = ["idiot", "id-iot", "a", "éß", "x" * 60, "ab1cd"]
    codes, of = toxicity.lettered(words)
    table = rng.normal(size=1 << 18)
    table[0] = 0
    got = toxicity.weighed(codes, table)
    for row, value in zip(codes.tolist(), got.tolist()):
        total, norm = 0.0, 0.0
        size = sum(c > 0 for c in row)
        for i in range(len(row)):
            for j in range(i + 1, len(row)):
                for k in range(j + 1, min(len(row), i + toxicity.REACH)):
                    if row[i] and row[j] and row[k]:
                        total += toxicity.DECAY ** (k - i - 2) * table[row[i] << 12 | row[j] << 6 | row[k]]
        for i in range(size):
            for j in range(i + 1, size):
                for k in range(j + 1, min(size, i + toxicity.REACH)):
                    norm += toxicity.DECAY ** (2 * (k - i - 2))
        assert abs(value - total / np.sqrt(max(norm, 1e-9))) < 1e-6
    assert max(of) == len(words) - 1


def test_words():
    assert toxicity.words_of("You i d i o t now a b") == ["you", "idiot", "now", "a", "b"]
    assert toxicity.words_of(None) == [] and toxicity.words_of(" ") == []


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op8_toxicity(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(rows) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for k, r in rows.items())
    held = [(rows[k]["predicted"], y) for k, y in labels.items() if rows[k]["held_out"]]
    right = np.array([p == y for p, y in held])
    caught = np.array([p for p, y in held if y])
    assert right.mean() > 0.95 and caught.mean() > 0.85


def test_gapped_insults_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    prose = lambda n: " ".join("".join(rng.choice(letters, int(rng.integers(1, 8)))) for _ in range(n))
    texts = [prose(30) + (f" {['moron', 'scum-bag', 'worthless'][k % 3]}. " if k % 4 == 0 else ". ") + prose(20) for k in range(400)]
    model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(400)])
    rows = [(1, None, "x"), (2, "", "x"), (3, "such a mo-ron", "x"), (4, "such a morxon", "x"), (5, "plain words here", "x"), (None, "worthless", "x"), (5, "plain words here", "x"), (6, "w o r t h l e s s", "x"), (7, "q" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r["doc_id"], r["predicted"]) for r in toxicity.scores(docs, model).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (None, 1), (5, 0), (6, 1), (7, 0)], key=str)
    assert sorted(str(r["doc_id"]) for r in toxicity.without_toxic(docs, model).collect()) == ["1", "2", "5", "5", "7"]
    none = toxicity.learned(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.scores(docs, none).collect()} == {0}
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_phrases_and_sentences(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnop")
    vocabulary = ["".join(rng.choice(letters, int(rng.integers(3, 8)))) for _ in range(300)]
    prose = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    texts = []
    for k in range(400):
        extra = "vile toad" if k % 4 == 0 else ["vile", "toad", "toad vile", "so vile a toad"][k % 3]
        texts.append(". ".join([" ".join(prose(15)), " ".join([*prose(4), extra, *prose(3)]), " ".join(prose(10))]))
    model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(400)])
    rows = [(1, "you are a vile toad and more"), (2, "a toad is vile"), (3, "one vi-le toaad here. fine words"), (4, "Nothing here.\nvile toad"), (5, "vile. toad"), (6, ""), (7, "漢字 かな 한글")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.scores(docs, model).collect()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}
    own = {(r["doc_id"], r["sentence"]): r["score"] >= 0.5 for r in toxicity.sentences(docs, model).collect()}
    assert own == {(1, 0): True, (2, 0): False, (3, 0): True, (3, 1): False, (4, 0): False, (4, 1): True, (5, 0): False, (5, 1): False, (7, 0): False}


def test_machine_and_kernel_by_definition():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 1, (60, 3)), rng.normal(-1, 1, (60, 3))])
    y, weights = np.array([1.0] * 60 + [-1.0] * 60), rng.uniform(0.5, 2, 120)
    w, b = toxicity._machine(x, y, weights)
    loss = lambda w, b: 1e-2 * w @ w + 1e-6 * b * b + (weights * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    best = loss(w, b)
    assert all(loss(w + d[:3], b + d[3]) >= best - 1e-9 for d in rng.normal(0, 0.05, (300, 4)))
    units = ["idiot", "id iot", "banana", "x"]
    places, marks = toxicity._marks(units)
    codes, _ = toxicity.lettered(units)
    got = toxicity._kernel(codes, places, marks)

    def phi(row):
        out = {}
        for i in range(len(row)):
            for j in range(i + 1, len(row)):
                for k in range(j + 1, min(len(row), i + toxicity.REACH)):
                    if row[i] and row[j] and row[k]:
                        u = (row[i], row[j], row[k])
                        out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    phis, lengths = [phi(r) for r in codes.tolist()], toxicity.norms(codes)
    want = [[sum(v * q.get(u, 0) for u, v in p.items()) / a / b for q, b in zip(phis, lengths)] for p, a in zip(phis, lengths)]
    assert np.allclose(got, want, atol=1e-5) and np.allclose(got[0], got[1], atol=1e-5)


def test_sample_does_not_depend_on_order(spark):
    docs = spark.createDataFrame([(k, f"text {k} {n}") for k in range(50) for n in range(2)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, n) for k in range(50) for n in (0, 1, None)], "doc_id long, toxic int")
    a, b = toxicity.sample(docs, labels), toxicity.sample(docs.repartition(7, "text"), labels.repartition(5, "toxic"))
    assert a == b and set(a[1]) == {1} and all(t.endswith(" 0") for t in a[0])


def test_fit_takes_little_memory_a_word():
    """Long texts of few words: what the fit holds of them is a few bytes a word, besides the machine's features."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "tu") for b in ("lan", "ser", "dov") for c in ("a", "en", "is", "o")]
    texts = [". ".join(" ".join(rng.choices(vocabulary, k=5)) for _ in range(500)) + (" zorblax." if k % 4 == 0 else ".") for k in range(160)]
    tracemalloc.start()
    try:
        model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(160)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.raw(["zorblax"])[0] > model.middle > model.raw(vocabulary).max()
    assert peak < 18e6  # 400,000 words; with a list entry for each it is 28 MB


def test_driver_is_tidied_between_sample_and_fit(spark, monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "sample", lambda *a, **k: done.append("sample") or ([], []))
    monkeypatch.setattr(toxicity, "released", lambda s: done.append("released"))
    monkeypatch.setattr(toxicity, "fit", lambda *a: done.append("fit"))
    toxicity.learned(spark.range(0), spark.range(0))
    assert done == ["sample", "released", "fit"]
