"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the hashes of a text's features (by weight) have it. To find all pairs within
`radius` bits, each bit position i gets a nonzero vector m(i) of radius + 1 bits; the table of each nonzero vector v keeps the
positions where <m(i), v> is odd. Any `radius` positions leave some v orthogonal to all their vectors, and in that table the
differing bits are masked out: every pair within the radius collides somewhere, for certain. Equal fingerprints are one node, so
copies never meet each other.

near_duplicates() links fingerprints of word shingles within 2 bits. Two fingerprints of a bucket can differ only where its table
masks bits out, and are within 2 bits exactly if they share a value with at most one of these bits flipped. So a bucket is
decided by groups of such values, of at most 29 fingerprints whatever the bucket's size; the pairs of a bucket are never formed.

one_of_each() is for texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8: they differ in few words, so
it takes PRINTS fingerprints of their words (weights: roots of the counts), the tables of RADIUS bits over each, and decides
each collision by the distance over all fingerprints, the sizes and then the exact Jaccard of the two texts. Nothing below the bar is
linked; a pair above it is missed if all its fingerprints are further apart than RADIUS (README: measured recall). A bucket is first
compared with one text only, its leader: the least one, or in buckets of more than FEW the one whose buckets are the largest in all,
which is nearest to the middle of its crowd, so a crowd has few leaders and most of it is linked to them. Texts that this puts into one
component aren't compared again. What is left of buckets of up to FEW texts meets pair by pair, and texts of larger ones (the crowd,
whose texts don't meet each other in small buckets as well) by the rarest shingles of each text, which texts at the bar must share. There the members of a shingle's most frequent component meet only texts outside it, and a pair is a row only if the parities
of its shingles, which tell how many differ at least, allow the bar. So the pairs of a large bucket are never formed.

Components come from rounds of hooking to the least neighbour and pointer jumping, each written to shared storage.

Results for odd inputs: a text without words (null, empty) has fingerprint zero and is linked like any other (one_of_each: is a copy
of the other texts without words); fewer words than a shingle: the whole sequence is the only shingle; repeated rows keep a row each;
null ids are kept and never name a component unless all of it has none; an empty table gives no rows; columns of any name may be there.
one_of_each tells rows apart by id and text: of a component the row of the least id stays (null ids last), and only one of the rows
that are equal in both; rows that share an id, or have none, stay if their texts aren't near copies.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, emptied, filled, filtered, released, task_memory, written

WORDS = 3
SEED = 42
M64 = (1 << 64) - 1
JACCARD_WORDS = 5
PRINTS, RADIUS = 6, 4
#: Two texts at a Jaccard of 0.8 have 26 of the 384 bits apart, give or take 5, if all their words are distinct, and less if not.
FAR = 56
#: Buckets of up to so many texts are compared pair by pair; so at most this many pairs come from a row.
FEW = 16
#: Bits of a text's parities of shingles; a pair's differing bits are at most as many as its differing shingles.
PARITIES = 1024
P_COLUMNS = [f"p{k}" for k in range(PARITIES // 64)]
STEPS = np.arange(1, PRINTS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
ROOTS = [isqrt(256 * k) for k in range(64)]
F_COLUMNS = [f"f{k}" for k in range(PRINTS)]


def masks(radius: int, bits: int = 64) -> list[int]:
    """A mask for each nonzero vector of radius + 1 bits."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """bytes.lower() and bytes.split() are the ASCII rules: A-Z, and the bytes 20 and 09 to 0D."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate([[0], ends[:n]]).tolist()
    ends = (ends - 1)[min(words, len(w)) - 1 :].tolist()
    joined = b" ".join(w)
    counts = np.zeros(64, "int64")
    for a in range(0, n, 1 << 14):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[a : min(n, a + (1 << 14))], ends[a : a + (1 << 14)])], "<u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_memory():
            for batch in batches:
                known: dict[str | None, int] = {}
                out = []
                for t in batch["text"].tolist():
                    if t not in known:
                        known[t] = signed(fingerprint(t, words))
                    out.append(known[t])
                yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array(out, "int64")})

    return docs.select(filled(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def tables(prints: list[Column], radius: int) -> Column:
    """(table, key, free) of every table over each fingerprint; free: the bits that the table masks out."""
    made = [(f * len(ms) + k, fp, m) for ms in [masks(radius)] for f, fp in enumerate(prints) for k, m in enumerate(ms)]
    return F.array(*[F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(signed(m))).alias("key"), F.lit(signed(~m & M64)).alias("free")) for t, fp, m in made])


def collisions(rows: DataFrame, prints: list[Column], radius: int) -> DataFrame:
    """rows (one for each distinct text or fingerprint) with table, key, free and size of each bucket of two or more that they are in."""
    keys = rows.select("*", F.explode(tables(prints, radius)).alias("t")).select(*rows.columns, "t.*")
    full = keys.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    return keys.join(full, ["table", "key"])


def links_within_two(fps: DataFrame) -> DataFrame:
    """u > v: links that join all fingerprints within 2 bits of each other into the same components. fps: distinct fp."""
    met = collisions(fps.select("fp"), [F.col("fp")], 2)
    flips = F.array(F.lit(0).cast("long"), *[F.col("free").bitwiseAND(F.lit(signed(1 << i))) for i in range(64)])
    near = met.select("table", "fp", F.explode(F.transform(F.array_distinct(flips), lambda x: F.col("fp").bitwiseXOR(x))).alias("value"))
    groups = near.groupBy("table", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    linked = groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    return linked.where("u != v").distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root (the least node of its component) of every node with a link."""
    links = cut(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct())
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"))
        least = cut(least)
        for _ in range(2):  # pointer jumping
            least = least.join(least.select(F.col("node").alias("up"), F.col("up").alias("higher")), "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
        least = cut(least)
        renamed = least.select(F.col("node").alias("root"), "up")
        roots = least.select("node", F.col("up").alias("root")) if roots is None else roots.join(renamed, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = cut(roots)
        ends = links.join(least.select(F.col("node").alias("u"), F.col("up").alias("a")), "u").join(least.select(F.col("node").alias("v"), F.col("up").alias("b")), "v")
        links = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")) if roots is None else roots


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (the least doc_id within reach) of every row."""
    prints = cut(fingerprints(docs, words, id_col, text_col))
    first = F.min(emptied(F.col("doc_id"))).alias("first")
    nodes = prints.groupBy("fp").agg(first)
    roots = components(links_within_two(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    names = nodes.join(named, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(emptied(F.col("doc_id")).alias("doc_id"), hexed(F.col("fp")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = JACCARD_WORDS) -> set[bytes]:
    """The ASCII rules of fingerprint()."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def word_fingerprints(words: list[bytes]) -> np.ndarray:
    """PRINTS fingerprints (signed) of a text's distinct words, weighted by the roots of their counts. A word's bits are its hash, mixed with a number for each fingerprint."""
    from xxhash import xxh64_intdigest

    counts = Counter(words)
    total, whole, names = np.zeros(64 * PRINTS), 0, list(counts)
    for a in range(0, len(names), 1 << 12):
        part = names[a : a + (1 << 12)]
        h = np.array([xxh64_intdigest(w, SEED) for w in part], "u8")[:, None] + STEPS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((h ^ (h >> np.uint64(31))).view("u1"), axis=1)
        weights = np.array([ROOTS[n] if n < 64 else isqrt(256 * n) for n in map(counts.__getitem__, part)], "f4")
        total += weights @ bits.astype("f4")  # whole numbers far below 2^24, so exact
        whole += int(weights.sum())
    return np.packbits(2 * total > whole).view("<i8") if names else np.zeros(PRINTS, "i8")


def distinct_shingles(words: list[bytes], n: int = JACCARD_WORDS) -> int:
    """How many different runs of n words there are, by 64-bit hashes of them."""
    if len(words) <= n:
        return min(1, len(words))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "u8") + np.uint64(1)
    h = np.zeros(len(ids) - n + 1, "u8")
    for k in range(n):
        h = (h ^ ids[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return len(np.unique(h))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def signatures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, n (shingles) and the fingerprints f0, f1, ... of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_memory():
            for batch in batches:
                known = dict(zip(batch["key"], batch["text"]))
                split = [(t or "").encode("utf-8", "replace").lower().split() for t in known.values()]
                prints = np.array([word_fingerprints(w) for w in split], "i8").reshape(-1, PRINTS)
                yield pd.DataFrame({"key": list(known), "n": [distinct_shingles(w) for w in split]} | {c: prints[:, k] for k, c in enumerate(F_COLUMNS)})

    schema = "key binary, n long, " + ", ".join(f"{c} long" for c in F_COLUMNS)
    return docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, schema)


def near(a: str, b: str) -> Column:
    """Whether the fingerprints of two sides are close enough in all: at most FAR bits."""
    return sum((F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}"))) for c in F_COLUMNS), F.lit(0)) <= FAR


def texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """key, text of the wanted keys, each once. Only texts whose key may be wanted travel."""
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    some = filtered(texts, F.xxhash64("key"), wanted, F.xxhash64("key")).where("__maybe").drop("__maybe")
    return some.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs u > v of nodes that are alike: by the sizes of their sets and the distance of some fingerprint, then by the texts. pairs: distinct u, v."""
    side = lambda c: prints.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("key", "n", *F_COLUMNS)])
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    fits = 5 * F.least("n_u", "n_v") >= 4 * F.greatest("n_u", "n_v")
    both = written(both.where(fits & near("u", "v")).select("u", "v", "key_u", "key_v"))
    wanted = both.select(F.col("key_u").alias("key")).unionByName(both.select(F.col("key_v").alias("key"))).distinct()
    texts = written(texts_of(docs, wanted, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, set()
        with task_memory():
            for batch in batches:
                good = []
                for v, a, b in zip(batch["v"], batch["a"], batch["b"]):
                    if v != last:  # rows often come in the order of v
                        last, seen = v, shingles(b)
                    good.append(alike(shingles(a), seen))
                yield batch.loc[good, ["u", "v"]]

    held = both.join(texts.select(F.col("key").alias("key_u"), F.col("text").alias("a")), "key_u").join(texts.select(F.col("key").alias("key_v"), F.col("text").alias("b")), "key_v")
    return held.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of PARITIES bits whether an odd number of the distinct hashes fall on it, as signed longs."""
    return np.packbits((np.bincount((tokens % np.uint64(PARITIES)).astype("i8"), minlength=PARITIES) & 1).astype("u1")).view("<i8")


def sharing(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node_a, node_b of all pairs of nodes with other roots that share a shingle which texts at the bar must share, are alike in size and near.

    With shingles ordered by the number of nodes that have them, the rarest first, two sets at the bar share one of the first
    n - 0.8 n + 1 of the larger and one of the first n - 8/9 n + 1 of the smaller. Shingles of one node come first, so a text with many of its own meets none, however large its crowd.
    Sets at the bar differ in at most a ninth of the sum of their sizes, and so do their parities: a text just below the bar is no row either.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        with task_memory():
            for batch in batches:
                found = [np.unique(np.array([xxh64_intdigest(x, SEED) for x in shingles(t)], "u8")).view("i8") for t in batch["text"]]
                bits = np.array([parities(x.view("u8")) for x in found], "i8").reshape(-1, len(P_COLUMNS))
                yield pd.DataFrame({"key": batch["key"], "tokens": found} | {c: bits[:, k] for k, c in enumerate(P_COLUMNS)})

    texts = texts_of(docs, nodes.select("key"), text_col)
    schema = "key binary, tokens array<long>, " + ", ".join(f"{c} long" for c in P_COLUMNS)
    held = written(texts.select("key", "text").mapInPandas(run, schema).join(nodes, "key").drop("key"))
    tokens = held.select("node", "root", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    released(docs.sparkSession)
    often = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("df > 1")
    shared = tokens.join(often, "token")
    place = W.partitionBy("node").orderBy("df", "token")  # a node has its text's shingles
    shared = shared.withColumns({"place": F.row_number().over(place), "own": F.col("size") - F.count("*").over(W.partitionBy("node"))})
    ahead = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1 - F.col("own")
    first = written(shared.where((F.col("place") <= ahead(0.8)) & (F.col("low") != F.col("high"))).select("token", "node", "root", "size", (F.col("own") + F.col("place")).alias("place"), (F.col("place") <= ahead(8 / 9)).alias("indexed")))
    released(docs.sparkSession)
    parts = first.groupBy("token", "root").agg(F.count("*").alias("k"), F.count_if("indexed").alias("i"))
    some = parts.groupBy("token").agg(F.sum("i").alias("i"), F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("most")).where("i > 0 AND roots > 1")
    first = first.join(some.select("token", "most"), "token").withColumn("outside", F.col("root") != F.col("most")).join(held.drop("tokens", "root"), "node")
    a, b = (first.select("token", "indexed", "outside", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "root", "size", "place", "n", *F_COLUMNS, *P_COLUMNS)]) for c in "ab")
    wants = F.when(F.col("outside"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    a, b = a.withColumn("meets", F.explode(wants)).drop("indexed", "outside"), b.where("indexed").withColumn("meets", F.col("outside")).drop("indexed", "outside")
    both_need = F.ceil((F.col("size_a") + F.col("size_b")) * 4 / 9 - 1e-9)  # shingles that the two have in common at the bar
    early = (F.col("place_a") <= F.col("size_a") - both_need + 1) & (F.col("place_b") <= F.col("size_b") - both_need + 1)
    alike_in_size = (F.col("n_b") <= F.col("n_a")) & (5 * F.col("n_b") >= 4 * F.col("n_a"))
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in P_COLUMNS), F.lit(0))
    at_bar = 9 * differ <= F.col("size_a") + F.col("size_b")
    met = a.join(b, ["token", "meets"]).where((F.col("root_a") != F.col("root_b")) & alike_in_size & early & near("a", "b") & at_bar)
    return met.select(F.greatest("node_a", "node_b").alias("node_a"), F.least("node_a", "node_b").alias("node_b"))


def near_copies(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """node, key of each distinct text, and u, v: links that join all near copies found into the same components."""
    prints = written(signatures(docs, text_col).dropDuplicates(["key"]).withColumn("node", F.monotonically_increasing_id()))
    made = [F.xxhash64(F.lit(f * len(ms) + k), F.col(c).bitwiseAND(F.lit(signed(m)))) for ms in [masks(RADIUS)] for f, c in enumerate(F_COLUMNS) for k, m in enumerate(ms)]
    buckets = prints.select("node", F.explode(F.array(*made)).alias("bucket"))
    whole = W.partitionBy("bucket")  # a row of a bucket is two numbers
    members = written(buckets.select("bucket", "node", F.count("*").over(whole).alias("size"), F.min("node").over(whole).alias("leader")).where("size > 1"))
    released(docs.sparkSession)
    crowded = members.where(F.col("size") > FEW)
    weight = written(crowded.groupBy("node").agg(F.sum("size").alias("weight")))
    central = crowded.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    flag = lambda c: weight.select(F.col("node").alias(c), F.lit(True).alias("crowd"))
    small = members.where(F.col("size") <= FEW).join(flag("leader"), "leader", "left")
    mixed = small.where("crowd").drop("crowd", "leader").join(flag("node"), "node", "left")  # led by one of the crowd: by another if they have one, or they aren't needed
    others = mixed.where("crowd IS NULL").groupBy("bucket").agg(F.min("node").alias("leader"))
    mixed = mixed.drop("crowd").join(others, "bucket")
    members = small.where("crowd IS NULL").drop("crowd").unionByName(written(mixed)).unionByName(written(crowded.drop("leader").join(central, "bucket")))
    released(docs.sparkSession)
    stars = written(members.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct())
    bare = prints.where("n = 0").select("node")  # they have no shingle to meet by
    bare = bare.join(F.broadcast(bare.agg(F.min("node").alias("v"))), F.col("node") > F.col("v")).select(F.col("node").alias("u"), "v")
    first = cut(verified(stars, prints, docs, text_col).unionByName(bare))
    released(docs.sparkSession)
    roots = components(first).select("node", "root")
    released(docs.sparkSession)

    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = stars.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")
    left = members.join(apart, (F.col("node") == F.col("u")) & (F.col("leader") == F.col("v")), "left_semi").select("bucket").distinct()
    rooted = members.join(left, "bucket", "left_semi").join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted)
    released(docs.sparkSession)
    sides = rooted.where(F.col("size") <= FEW).join(prints.drop("key"), "node").join(flag("node"), "node", "left")
    a, b = (sides.select("bucket", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "root", "n", "crowd", *F_COLUMNS)]) for c in "ab")
    fits = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
    unmet = (F.col("root_a") != F.col("root_b")) & (F.isnull("crowd_a") | F.isnull("crowd_b"))  # two of the crowd meet by their shingles
    both = a.join(b, "bucket").where((F.col("node_a") > F.col("node_b")) & unmet & fits & near("a", "b")).select("node_a", "node_b")
    crowd = weight.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    both = both.unionByName(sharing(written(crowd.join(prints, "node")), docs, text_col))
    rest = both.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct().join(stars, ["u", "v"], "left_anti")
    return prints.select("node", "key"), first.unionByName(verified(rest, prints, docs, text_col))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that have a near copy of a smaller id; all columns stay."""
    nodes, links = near_copies(docs, text_col)
    roots = nodes.join(components(links), "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key")).groupBy("id", "key").agg(F.count("*").alias("rows"))
    rows = written(rows.join(roots, "key"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "key", "rows")).alias("kept"))
    id_, key = f"__id_{uuid.uuid4().hex}", f"__key_{uuid.uuid4().hex}"
    keep = cut(kept.select(F.col("kept.id").alias(id_), F.col("kept.key").alias(key), F.col("kept.rows").alias("rows")))
    other = rows.join(keep, F.col("id").eqNullSafe(F.col(id_)) & (F.col("key") == F.col(key)), "left_anti")
    hashed = F.xxhash64(F.col(id_col).cast("long"), text_key(F.col(text_col)))
    parted = filtered(docs, hashed, written(other.select("id", "key")), F.xxhash64("id", "key"))
    unsure = parted.where("__maybe").join(keep.drop("rows"), F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (text_key(F.col(text_col)) == F.col(key)), "left_semi")
    out = parted.where("NOT __maybe").unionAll(unsure).drop("__maybe")  # a row of no dropped hash stays for sure
    return out if keep.where("rows > 1").isEmpty() else out.withColumn(key, text_key(F.col(text_col))).dropDuplicates([id_col, key]).drop(key)
