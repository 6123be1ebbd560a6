import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.llm import queries, sharding


def plain_bfd(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[k]]
        if fits:
            b = min(fits)[1]
        else:
            left.append(max(capacity, sizes[k]))
            b = len(left) - 1
        left[b] -= sizes[k]
        out[k] = b
    return out


def runs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def expanded(sizes, pieces):
    """The bin of each of the sizes, largest first."""
    runs = runs_of(sizes)
    parts = sharding.parted(runs, pieces, 1 + max((b for _, _, b in pieces), default=0))
    of = {(k, first + n): b for b, x in enumerate(parts) for k, first, count in x for n in range(count)}
    assert len(of) == len(sizes)
    return [of[k, n] for k, (_, count) in enumerate(runs) for n in range(count)]


def test_runs_agree_with_a_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.choice([1, 5, 70, rng.randint(1, 60)]) for _ in range(rng.randint(0, 150))), reverse=True)
        assert expanded(sizes, sharding.best_fit_decreasing(runs_of(sizes), 60)) == plain_bfd(sizes, 60)


def test_shards(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = queries.op5_sharding(spark, "/root/testdata/sf0.01").collect()
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    where, load, slots = {}, {}, {}
    for r in got:
        t = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 8, zlib.crc32(t), "bytes")
        assert where.setdefault(t, r["shard"]) == r["shard"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(load) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 24


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "b", 7), (3, "b", 7), (3, "b", 7), (4, "é" * 50, 7)], "doc_id long, text string, shard int")
    got = sharding.shard(docs, capacity=60).collect()
    by = {}
    for r in got:
        by.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(got) == 6 and all(len(s) == 1 for s in by.values())
    assert [r["size"] for r in got if r["doc_id"] == 1] == [8]
    assert sharding.shard(docs.limit(0), shards=24).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    rng = random.Random(7)
    texts = ["copy " * 20] * 1000 + ["%09d" % k * rng.randint(1, 20) for k in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    load = {}
    for r in sharding.shard(docs, shards=24).collect():
        load.setdefault(r["shard"], []).append(r["size"])
    assert sorted(load) == list(range(24))
    rest = sorted(sum(x) for x in load.values())[:-1]
    assert max(sum(x) for x in load.values()) == 1000 * 108
    assert max(rest) - min(rest) < 0.02 * sum(rest) / 23


def test_even_shards_with_large_items():
    for sizes in ([], [5], [100, 1, 1, 1], [1000, 500, *[3] * 600], [10**9, *[7] * 5000], [9, 9, 9, 9, 9]):
        got = expanded(sizes, sharding.even_shards(runs_of(sizes), 4))
        load = [sum(s for s, b in zip(sorted(sizes, reverse=True), got) if b == k) for k in range(4)]
        assert sum(load) == sum(sizes)
        assert sum(1 for x in load if x) == min(4, len(sizes))


def test_repeated_rows_and_one_size(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 50)
    rows = [(1, "same")] * 3000 + [(None, None)] * 10 + [(k, "%05d" % k) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "size": F.lit("y"), "text_key": F.lit("z"), "heap": F.lit(1)}).repartition(5)
    slots, where = {}, {}
    for r in sharding.shard(docs, shards=24).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(map(len, slots.values())) == len(rows) and all(len(s) == 1 for s in where.values())
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(x) for x in slots.values() if len(x) < 1000} <= {130, 131} | set(range(120, 141))


def test_capacity_in_heaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SHARDS_PER_HEAP", 8, raising=False)
    rng = random.Random(9)
    texts = ["%08d" % (k % 19_000) for k in range(20_000)] + ["%04d" % k * rng.randint(5, 200) for k in range(100)] + ["giant " * 10] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    load, where, slots = {}, {}, {}
    for r in sharding.shard(docs, capacity=4000).collect():
        t = texts[r["doc_id"]]
        assert where.setdefault(t, r["shard"]) == r["shard"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    total = sum(len(t) + 8 for t in texts)
    assert sum(load.values()) == total and sorted(load) == list(range(len(load)))
    assert [s for s, x in load.items() if x > 4000] == [where["giant " * 10]] and load[where["giant " * 10]] == 6800
    assert len(load) <= 1.2 * total / 4000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
