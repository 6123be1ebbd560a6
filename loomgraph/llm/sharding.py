"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are packed whole, largest first, each into the shard with the least remaining capacity that holds it; a
balanced tree keeps the remaining capacities in order. Groups of one size are alike, so the packing runs over sizes with their
numbers of groups: the tightest shard takes as many of a size as fit, which is what one by one would give. There are at most
sqrt(2 x all bytes) different sizes, and a task packs them. At a fixed capacity the groups are dealt by hash into heaps of SHARDS_PER_HEAP
shards' worth, each packed by a task (so each heap may leave one shard part full). With a number of shards in place of a
capacity, each group above the mean of what remains has a shard of its own, and the smallest capacity that needs no more than
the other shards is searched for.

A group's rank among those of its size names its shard; ranks come from salted sub-groups with offsets from their counts, and so do slots,
from the tasks that hold the placed rows. So no task holds a size, a shard or a group of copies, and rows that repeat are no hot key.

Results for odd inputs: a null text counts as an empty one (equal to it, size 8); repeated rows are rows of their own; a group
larger than the capacity gets a shard of its own; groups of one size are told apart by a hash of the text; an empty table gives
no rows. Texts of any length count whole. Only the id and text columns are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, emptied, filled, tasks_for

SHARDS_PER_HEAP = 256
GROUPS_PER_TASK = 100_000

#: Packed pieces: of the groups with the k-th of some sizes, those from the given rank on are in a bin.
Pieces = list[tuple[int, int, int]]


class Remaining:
    """Ordered set of (remaining capacity, shard): a treap, so each step takes logarithmic time in the number of shards."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 1

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.seed >> 20, None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and give the least key with a capacity of at least size."""
        left, rest = self._split(self.root, (size, -1))
        if rest is None:
            self.root = left
            return None
        t, up = rest, None
        while t[2] is not None:
            up, t = t, t[2]
        if up is None:
            rest = t[3]
        else:
            up[2] = t[3]
        self.root = self._merge(left, rest)
        return t[0]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> Pieces | None:
    """(run, first rank, bin) of runs (size, groups), largest size first; a group above the capacity has a bin of its own. None if it takes more than `most` bins."""
    bins, out, made = Remaining(), [], 0
    for k, (size, left) in enumerate(runs):
        rank = 0
        while rank < left:
            found = bins.take(size)
            if found is None:
                if made == most:
                    return None
                found = (max(capacity, size), made)
                made += 1
            n = min(left - rank, found[0] // size if size else left)
            out.append((k, rank, found[1]))
            bins.insert((found[0] - n * size, found[1]))
            rank += n
    return out


def parted(runs: list[tuple[int, int]], pieces: Pieces, bins: int) -> list[list[tuple[int, int, int]]]:
    """What each bin has: (run, first rank, groups), in the order of the runs."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    for (k, first, b), after in zip(pieces, [*pieces[1:], (-1, 0, 0)]):
        out[b].append((k, first, (after[1] if after[0] == k else runs[k][1]) - first))
    return out


def halved(runs: list[tuple[int, int]], bin_: list[tuple[int, int, int]]) -> tuple[list, list]:
    """A bin's groups in two bins as even as largest-first gives."""
    halves, loads = ([], []), [0, 0]
    for k, first, n in bin_:
        size = runs[k][0]
        while n:
            lighter = int(loads[0] > loads[1])
            gap = loads[1 - lighter] - loads[lighter]
            take = min(n, max(1, gap // size)) if size and gap else (n + 1) // 2
            halves[lighter].append((k, first, take))
            loads[lighter] += take * size
            first, n = first + take, n - take
    return halves


def even_shards(runs: list[tuple[int, int]], shards: int) -> Pieces:
    """Each group above the mean of what remains has a shard of its own; the others go by best-fit-decreasing at the least capacity found to need at most the other shards."""
    left, groups, alone = sum(s * n for s, n in runs), sum(n for _, n in runs), []
    rest = []
    for k, (size, n) in enumerate(runs):
        own = 0
        while own < n and len(alone) < min(shards - 1, groups) and size * (shards - len(alone)) > left:
            alone.append([(k, own, 1)])
            left -= size
            own += 1
        rest.append((size, n - own))
    few, offsets = [r for r in rest if r[1]], [(k, n - r[1]) for k, ((_, n), r) in enumerate(zip(runs, rest)) if r[1]]
    open_ = shards - len(alone)
    low = max(1, -(-left // open_))
    high, best = 2 * low + 1, None
    while best is None or low < high and high - low > left // open_ // 100_000:
        middle = high if best is None else (low + high) // 2
        found = best_fit_decreasing(few, middle, open_)
        if found is not None:
            best, high = found, middle
        elif best is None:
            high *= 2
        else:
            low = middle + 1
    bins = [b for b in parted(few, best, open_) if b]
    while len(bins) < open_:  # few large groups may need fewer bins: the fullest are halved
        full = max((k for k, b in enumerate(bins) if sum(n for _, _, n in b) > 1), key=lambda k: sum(few[r][0] * n for r, _, n in bins[k]), default=None)
        if full is None:
            break
        bins[full : full + 1] = halved(few, bins[full])
    bins = alone + [[(offsets[k][0], offsets[k][1] + first, n) for k, first, n in b] for b in bins]
    return sorted((k, first, b) for b, x in enumerate(bins) for k, first, _ in x)


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. Give the number of shards, or a capacity in bytes to use as few as can be."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(filled(F.col(id_col)).alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("text_key"))
    groups = cut(rows.groupBy("text_key").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    heaps = tasks_for(total["s"] or 0, SHARDS_PER_HEAP * capacity) if capacity else 1
    groups = groups.withColumn("heap", F.pmod(F.xxhash64(F.lit(1), "text_key"), F.lit(heaps)).cast("int"))

    def packed(heap: pd.DataFrame) -> pd.DataFrame:
        heap = heap.sort_values("size", ascending=False)
        runs = list(zip(heap["size"].tolist(), heap["n"].tolist()))
        pieces = best_fit_decreasing(runs, capacity) if capacity else even_shards(runs, shards)
        firsts, bins = [[] for _ in runs], [[] for _ in runs]
        for k, first, b in pieces:
            firsts[k].append(first)
            bins[k].append(b)
        return pd.DataFrame({"heap": heap["heap"].to_numpy(), "size": heap["size"].to_numpy(), "firsts": firsts, "bins": bins, "used": max((b for _, _, b in pieces), default=-1) + 1})

    pieces = cut(groups.groupBy("heap", "size").agg(F.count("*").alias("n")).groupBy("heap").applyInPandas(packed, "heap int, size long, firsts array<long>, bins array<int>, used int"))
    used = pieces.groupBy("heap").agg(F.max("used").alias("used"))  # one row a heap
    start = used.select("heap", F.expr("coalesce(sum(used) over (order by heap rows between unbounded preceding and 1 preceding), 0)").alias("start"))
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(tasks_for(total["n"], GROUPS_PER_TASK))).cast("int"))
    before = salted.groupBy("heap", "size", "salt").count().select("heap", "size", "salt", F.expr("coalesce(sum(count) over (partition by heap, size order by salt rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    rank = F.expr("row_number() over (partition by heap, size, salt order by text_key)") - 1
    ranked = salted.withColumn("place", rank).join(before, ["heap", "size", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    where = F.element_at("bins", F.size(F.filter("firsts", lambda f: f <= F.col("rank"))))
    named = ranked.join(pieces, ["heap", "size"]).join(start, "heap").select("text_key", (F.col("start") + where).cast("int").alias("shard"))

    placed = cut(rows.join(named, "text_key").select("doc_id", "size", "text_crc32", "shard"))
    placed = placed.withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    earlier = placed.groupBy("shard", "task").count().select("shard", "task", F.expr("coalesce(sum(count) over (partition by shard order by task rows between unbounded preceding and 1 preceding), 0)").alias("earlier"))
    out = placed.withColumn("rank", F.expr("row_number() over (partition by shard, task order by at)")).join(earlier, ["shard", "task"])
    return out.select(emptied(F.col("doc_id")).alias("doc_id"), "size", "text_crc32", "shard", (F.col("earlier") + F.col("rank") - 1).cast("long").alias("slot"))
