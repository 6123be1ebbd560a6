import random

from pyspark.sql import functions as F

from loomgraph.llm import simhash


def brute(rows):
    """The rows kept: the least id of each component of texts with a 5-word Jaccard of at least 0.8."""
    sets = [simhash.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= 0.8:
                root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(i, best.get(find(k), i))
    return sorted(best.values())


def family(rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 300))]
        for edits in (0, 1, 2, 3, 6, 10):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows + ["", " \n", "a b", "A  b", "a b c"]))


def test_drops_near_copies_of_five_words(spark):
    rows = family(random.Random(4))
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert set(want) <= set(got) and len(got) <= 1.02 * len(want) and len(want) < len(rows) - 50  # nothing below the bar is linked; pairs at the bar may be missed


def test_crowds_lose_no_pair(spark):
    """Variants of one text, most of them below the bar with each other, some just above it."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(rng.choice([3, 5, 6])):
            copy[rng.randrange(150)] = word()
        rows.append((k, " ".join(copy)))
        if k % 10 == 0:
            copy[rng.randrange(150)] = word()
            rows.append((1000 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}, brute(rows)
    assert set(want) <= got and len(got) <= len(want) + 2 and 20 < len(want) < len(rows)


def crowd(n, rng):
    """A text, many variants of it at and below the bar, and variants of these."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [list(base)]
    for k in range(n):
        copy = list(rows[rng.randrange(len(rows))] if k % 10 == 0 else base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 3, 4, 5, 7])):
            copy[at] = word()
        rows.append(copy)
    rng.shuffle(rows)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    """What is compared besides the leaders of buckets is a few pairs a text, and no link is lost by that."""
    real, calls = simhash.verified, []

    def counted(pairs, *rest):
        pairs = simhash.written(pairs)
        calls.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    rows = crowd(400, random.Random(12))
    got = sorted(r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and 20 < len(got) < len(rows) / 2
    stars, rest = calls
    assert rest < 2 * len(rows) and stars < 40 * len(rows), calls


def test_parities_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (0, 1, 20, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype="u8"))
        for edits in (0, 1, 7, 500):
            b = np.unique(np.concatenate([a[edits:], rng.integers(0, 1 << 63, edits, dtype="u8")]))
            bits = sum((int(x) ^ int(y)).bit_count() for x, y in zip(simhash.parities(a).view("u8"), simhash.parities(b).view("u8")))
            assert bits <= len(np.setxor1d(a, b)) and (edits or not bits) and (edits == 500 or bits > 0.9 * len(np.setxor1d(a, b)) - 2)


def test_texts_without_words_are_copies_in_any_crowd(spark):
    rows = [(k, " " * k) for k in range(30)] + [(100 + k, f"word{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, *range(100, 130)]


def test_odd_rows(spark):
    texts = ["q r s t u v", "other words that are no copy", "q r s t u v", None, ""]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, "seven one two"), (7, "something else"), (7, "something else"), (8, "Seven  one two")], "doc_id long, text string")
    got = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(None, texts[0].split()), (None, texts[1].split()), (None, []), (7, ["seven", "one", "two"]), (7, ["something", "else"])], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    clashing = docs.withColumns({"__key": F.lit(1), "key": F.lit(2), "rows": F.lit(3), "__id": F.lit(4), "table": F.lit(5)})
    assert simhash.one_of_each(clashing).count() == len(got) and simhash.one_of_each(clashing).columns == clashing.columns


def test_texts_without_copies_do_not_travel(spark):
    """Only what may be a near copy is shuffled with its text; the bytes that shuffles write are those of keys and numbers."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(k, " ".join(word() for _ in range(4000))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(3)]
    docs = simhash.written(spark.createDataFrame(rows, "doc_id long, text string"))
    store = spark._jsc.sc().statusStore()

    def moved():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before = moved()
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == list(range(60))
    total = sum(n for k, n in moved().items() if k not in before)
    assert total < 63 * 36_000 / 2, total


def test_executors_collect_garbage_too(spark):
    """One full collection comes from the driver's call; in a local session the tasks' ones are counted in the same process."""
    from loomgraph.llm.common import released

    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return max(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName() or "Major" in b.getName())

    before = full()
    released(spark)
    assert full() - before >= 2
