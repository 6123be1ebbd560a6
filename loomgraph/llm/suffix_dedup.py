"""Suffix-array dedup: remove each byte that a string of SPAN bytes covers which also starts anywhere else.

Dealing out. Windows are the strings of SPAN bytes. The anchor of a window is the leftmost of its GRAM-byte strings with the
least hash; equal windows have equal anchors, so only windows with the same anchor need to meet. Consecutive windows of a text
with the same anchor are one region (SPAN bytes and one more for each further window). Regions are counted by the hashes of
their anchor and of their bytes; a region is sorted only if its anchor occurs twice, and equal regions are sorted once, with
their number. So copies, however many, meet as one region, and unique text never travels.

An anchor with more than HOT different regions, or more than LOCAL in one task (a passage that very many texts share, each with other surroundings),
would gather them all in one block. A task names such an anchor in place of its regions, and the count over all tasks is exact for the
others. The regions of these anchors are dealt out as single windows, each under its own hash, so that only equal windows meet;
that takes a reading more. A task is told only of the anchors that it has itself.

Sorting. The regions of an anchor come together in a block, and a region found more than once stands there twice. The block's windows are
sorted in two stages: a suffix that is smaller than its successor is sorted directly by its first SPAN bytes; the others are induced from it by
one scan of the buckets of first bytes, in ascending order (a suffix larger than its successor follows from the place of its successor, which
stands in an earlier bucket, or earlier in the same one). Neighbours in the order with a common prefix of SPAN bytes or more are repeats.

Texts are read three times (anchors, regions, removal; a fourth time for single windows) and never shuffled. A task sends each distinct
region's hashes and count once, however often it has it. What the later readings need is written to the shared folder by the number of the
task that needs it; a task that doesn't find what it was asked for stops. Input that comes out of a shuffle is written down first, so that a
task's texts are the same each time.

Results for odd inputs: a null or empty text has no bytes and nothing to remove; texts under SPAN bytes keep all; repeated rows
remove each other; null ids are kept; any bytes and lengths work, matches never cross texts; an empty table gives no rows. Only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, emptied, filled, settled, shared_dir, task_memory
from .warc import opened

SPAN = 200
GRAM = 32
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1
REGION = np.dtype([("h", "<u8"), ("r", "<u8"), ("n", "<u2"), ("count", "<u4")])
RUN = np.dtype([("h", "<u8"), ("r", "<u8"), ("first", "<u2"), ("last", "<u2")])
BLOCK = 700_000
HOT = 20_000
LOCAL = 64
MOST_FOLDERS = 4096
NO_ANCHORS = np.zeros(0, "<u8")


class Hashes:
    """Hashes of any part of a buffer from one pass: sums of byte values times powers of an odd base, modulo 2^64."""

    _table = np.random.default_rng(7).integers(0, 2**64, 256, dtype="u8")
    _pow = np.ones(1, "u8")
    _inv = np.ones(1, "u8")

    @classmethod
    def powers(cls, n: int) -> None:
        if len(cls._pow) < n:
            cls._pow = np.concatenate([np.ones(1, "u8"), np.full(n, BASE, "u8").cumprod()])
            cls._inv = np.concatenate([np.ones(1, "u8"), np.full(n, pow(BASE, -1, 1 << 64), "u8").cumprod()])

    def __init__(self, raw: np.ndarray):
        self.powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, "u8")
        np.cumsum(self._table[raw] * self._pow[: len(raw)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self._inv[start]
        return mixed(h)

    def grams(self, n: int) -> np.ndarray:
        count = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:count]) * self._inv[:count])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def anchors(raw: np.ndarray, starts: np.ndarray, hot: np.ndarray = NO_ANCHORS, only_hot: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The regions of texts that stand one after the other in raw, and where they begin; starts: of each text, and the end.

    The regions of hot anchors come as single windows, under hashes of their own; on demand they alone.
    """
    none = np.zeros(0, REGION), np.zeros(0, "int64")
    w = SPAN - GRAM + 1
    if len(raw) < SPAN:
        return none
    hashes = Hashes(raw)
    gram = hashes.grams(GRAM)
    value = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype="u8")
    rows = -(-len(value) // w)
    blocks = np.full(rows * w, M64, "u8")
    blocks[: len(value)] = value
    blocks = blocks.reshape(rows, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(raw) - SPAN + 1
    least = (np.minimum(after[:windows], before[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype("int64")
    inside = np.zeros(len(raw) + 1, "i4")
    long = np.flatnonzero(np.diff(starts) >= SPAN)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long + 1] - SPAN + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:windows]))
    if not len(at):
        return none
    own = least[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    lo, hi = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    out = np.zeros(len(lo), REGION)
    out["h"], out["n"], out["count"] = gram[own[new]], hi - lo + 1, 1
    out["r"] = mixed(hashes.of(lo, hi + SPAN) + (own[new] - lo).astype("u8") + ((hi - lo).astype("u8") << np.uint64(32)))
    if not len(hot) or not (split := np.isin(out["h"], hot)).any():
        return none if only_hot else (out, lo)
    n = out["n"][split].astype("int64")
    first = np.repeat(lo[split], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    single = np.zeros(len(first), REGION)
    window = hashes.of(first, first + SPAN)
    single["h"], single["r"], single["n"], single["count"] = mixed(window + np.uint64(1)), mixed(window + np.uint64(2)), 1, 1
    if only_hot:
        return single, first
    out, lo = np.concatenate([out[~split], single]), np.concatenate([lo[~split], first])
    order = np.argsort(lo, kind="stable")
    return out[order], lo[order]


def chunks(rows: Iterator[tuple]) -> Iterator[tuple[list, list[bytes], np.ndarray, np.ndarray]]:
    """Groups of rows of about CHUNK bytes: ids, texts, all bytes, starts of the texts."""
    ids, texts, size = [], [], 0
    for id_, text in rows:
        raw = b"" if text is None else text.encode("utf-8", "replace")
        ids.append(id_)
        texts.append(raw)
        size += len(raw)
        if size >= CHUNK or len(ids) >= 20_000:
            yield _chunk(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield _chunk(ids, texts)


def _chunk(ids: list, texts: list[bytes]):
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("int64")
    return ids, texts, np.frombuffer(b"".join(texts), "u1"), starts


def summed(regions: np.ndarray) -> np.ndarray:
    """One of each (h, r), sorted, with the sum of the counts."""
    if not len(regions):
        return regions
    regions = regions[np.lexsort((regions["r"], regions["h"]))]
    first = np.flatnonzero(np.concatenate([[True], (regions["h"][1:] != regions["h"][:-1]) | (regions["r"][1:] != regions["r"][:-1])]))
    out = regions[first].copy()
    out["count"] = np.minimum(np.add.reduceat(regions["count"].astype("int64"), first), 2**32 - 1)
    return out


def find(known: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """The place of each region in known (sorted by r), or -1."""
    if not len(known):
        return np.full(len(regions), -1)
    at = np.searchsorted(known["r"], regions["r"])
    at[at == len(known)] = 0
    return np.where((known["r"][at] == regions["r"]) & (known["h"][at] == regions["h"]), at, -1)


def sorted_windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the windows of all regions begin, in the order of their first SPAN bytes, by two-stage sorting.

    text: the regions one after the other, then SPAN zero bytes and a byte of 255; starts and counts: a region's first window and number of windows.
    What follows a region decides only the order of windows that are equal.
    """
    n = len(text)
    nearest = np.full(n, n - 2)
    nearest[:-1] = np.where(text[1:] != text[:-1], np.arange(n - 1), n - 2)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # the last byte of a run
    smaller = text[nearest] < text[nearest + 1]  # than its successor; in a run the first other byte decides
    direct = np.flatnonzero(smaller)
    ends = direct[np.searchsorted(direct, starts + counts - 1)]  # a chain of larger suffixes ends at one that is sorted directly
    wanted = np.zeros(n + 1, "i4")
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, ends + 1, -1)
    wanted = np.cumsum(wanted)[:n] > 0
    window = np.zeros(n + 1, "i4")
    np.add.at(window, starts, 1)
    np.add.at(window, starts + counts, -1)
    window = np.cumsum(window)[:n] > 0
    seeds = direct_sort(text, np.flatnonzero(smaller & wanted))
    by_byte = np.searchsorted(text[seeds], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = wanted & ~smaller
    out = []
    for byte in range(256):
        parts = induced[byte]
        last = np.concatenate(parts) if parts else np.zeros(0, "int64")
        parts = [last] if len(last) else []
        while len(last):  # runs of this byte
            last = last[last > 0] - 1
            last = last[larger[last] & (text[last] == byte)]
            if len(last):
                parts.append(last)
        parts.append(seeds[by_byte[byte] : by_byte[byte + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket[window[bucket]])
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (text[before] > byte)]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            induced[text[part[0]]].append(part)
        induced[byte] = []
    return np.concatenate(out) if out else np.zeros(0, "int64")


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number (a view)."""
    return np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))


def direct_sort(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places sorted by the SPAN bytes from there on; equal strings stand together. Ties are refined eight bytes at a time; groups of equal strings are left."""
    padded = np.concatenate([text, np.zeros(SPAN + 16, "u1")])
    words, hashes = eights(padded), Hashes(padded)
    key = words[at].astype("u8")
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype("int64")])) if len(at) else np.zeros(0, "int64")
    places, active = np.arange(len(at)), np.arange(len(at))
    whole = hashes.of(at, at + SPAN)
    for depth in range(8, SPAN, 8):
        g = group[active]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if not len(first):
            break
        number = np.cumsum(new) - 1
        unequal = np.maximum.reduceat((whole[active] != whole[active[first]][number]).astype("i1"), first) > 0
        keep = unequal[number]
        active = active[keep]
        if not len(active):
            break
        g = group[active]
        key = words[at[active] + depth].astype("u8")
        order = np.lexsort((key, g))
        moved = active[order]
        at[active], whole[active] = at[moved], whole[moved]
        key, g = key[order], g[order]
        split = np.concatenate([[0], ((key[1:] != key[:-1]) | (g[1:] != g[:-1])).astype("int64")])
        group[active] = np.cumsum(split) + len(places) * (depth // 8)
    return at


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each window but the last in the order: whether it has SPAN bytes in common with the next.

    Neighbours that agree in their first bytes are compared along diagonals: where windows that follow each other in the text have
    neighbours that do, too, their common bytes are compared once.
    """
    words = eights(text)
    alive = np.arange(len(order) - 1)
    for depth in range(0, 40, 8):
        alive = alive[words[order[alive] + depth] == words[order[alive + 1] + depth]]
    out = np.zeros(max(0, len(order) - 1), bool)
    if not len(alive):
        return out
    pair = np.full(len(text), -1)
    pair[order[alive]] = alive
    at = np.flatnonzero(pair >= 0)  # in the order of the text
    pair = pair[at]
    gap = order[pair + 1] - at
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])]))
    length = np.diff(np.concatenate([new, [len(at)]]))
    sizes = length + SPAN - 1  # bytes of each diagonal
    if sizes.sum() > 30 * len(at):  # most are short: eight bytes at a time is less work
        for depth in range(40, SPAN, 8):
            alive = alive[words[order[alive] + depth] == words[order[alive + 1] + depth]]
        out[alive] = True
        return out
    begins = np.cumsum(sizes) - sizes
    left = np.arange(sizes.sum()) + np.repeat(at[new] - begins, sizes)
    differ = np.concatenate([[0], np.cumsum(text[left] != text[left + np.repeat(gap[new], sizes)])])
    first = np.repeat(begins, length) + np.arange(len(at)) - np.repeat(new, length)
    out[pair[differ[first + SPAN] == differ[first]]] = True
    return out


def repeats(regions: list[bytes], counts: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of repeated windows: region, first and last window. twice: the region was found more than once, and so stands twice in what is sorted."""
    again = np.flatnonzero(twice)
    text = np.frombuffer(b"".join([*regions, *(regions[k] for k in again.tolist()), bytes(SPAN)]) + b"\xff" * 8, "u1")
    sizes = np.array([len(r) for r in regions], "int64")
    sizes, numbers = np.concatenate([sizes, sizes[again]]), np.concatenate([counts, counts[again]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = sorted_windows(text, starts, numbers)
    same = common_prefixes(text, order)
    flags = np.zeros(len(text) + 2, "i1")
    flags[order[:-1][same] + 1] = 1
    flags[order[1:][same] + 1] = 1
    edges = np.diff(flags)  # runs end with their region, as its last bytes begin no window
    first, after = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    region = np.searchsorted(starts, first, "right") - 1
    own = region < len(regions)
    region, first, after = region[own], first[own], after[own]
    return region, first - starts[region], after - 1 - starts[region]


def removed(size: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a text of `size` bytes that the windows beginning in `runs` (first, last) cover, joined."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + SPAN)
        else:
            out.append([first, last + SPAN])
    return [(a, min(b, size)) for a, b in out]


def _ask(rows: DataFrame, folder: str, tasks: int) -> tuple[str, int]:
    """Write rows (task, blob) so that a task can read its own; the folder, and how many tasks share a part of it."""
    share = -(-tasks // MOST_FOLDERS)
    rows = rows.withColumn("part", F.expr(f"task div {share}")).repartition(min(tasks, MOST_FOLDERS), "part").sortWithinPartitions("part", "task")
    rows.write.option("parquet.block.size", 8 << 20).partitionBy("part").parquet(folder)
    return folder, share


def _asked(where: tuple[str, int], task: int, dtype: np.dtype) -> np.ndarray:
    import pyarrow.parquet as pq

    fs, root = opened(where[0])
    from pyarrow.fs import FileSelector

    files = [f.path for f in fs.get_file_info(FileSelector(f"{root}/part={task // where[1]}", allow_not_found=True)) if f.path.endswith(".parquet")]
    blobs = [b for f in sorted(files) for b in pq.read_table(f, columns=["blob"], filesystem=fs, partitioning=None, filters=[("task", "=", task)]).column("blob").to_pylist()]
    return np.frombuffer(b"".join(blobs), dtype)


def _by_task(blobs: dict[int, list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(t, np.concatenate(b).tobytes()) for t, b in sorted(blobs.items())], columns=["task", "blob"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    with task_memory():
        for batch in batches:
            yield from zip(batch["id"].tolist(), batch["text"].tolist())


def _split(regions: np.ndarray, task: int, parts: int) -> pd.DataFrame:
    part = (regions["h"] % np.uint64(parts)).astype("int64")
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(k, task, regions[order[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pd.DataFrame(rows, columns=["part", "task", "blob"])


def crowded(regions: np.ndarray, local: int) -> np.ndarray:
    """summed() regions of a task, with one row of no windows in place of more than `local` of one anchor."""
    if not len(regions):
        return regions
    first = np.flatnonzero(np.concatenate([[True], regions["h"][1:] != regions["h"][:-1]]))
    n = np.diff(np.concatenate([first, [len(regions)]]))
    many = np.repeat(n > local, n)
    many[first] = False
    out = regions.copy()
    out["n"][first[n > local]] = 0
    return out[~many]


def meet(rows: pd.DataFrame, hot_above: int) -> pd.DataFrame:
    """Regions whose anchor occurs twice: for the task that is to send each (kind 0), and all tasks that have it (kind 1). Crowded anchors: for all tasks that have them (kind 2)."""
    part = int(rows["part"].iloc[0])
    rows = rows.sort_values("task")
    blobs = [np.frombuffer(b, REGION) for b in rows["blob"]]
    regions = np.concatenate(blobs)
    task = np.repeat(rows["task"].to_numpy(), [len(b) for b in blobs])
    order = np.lexsort((task, regions["r"], regions["h"]))
    regions, task = regions[order].copy(), task[order]
    other_h = np.concatenate([[True], regions["h"][1:] != regions["h"][:-1]])
    other = other_h | np.concatenate([[True], regions["r"][1:] != regions["r"][:-1]])
    first_h, first, of = np.flatnonzero(other_h), np.flatnonzero(other), np.cumsum(other_h) - 1
    often = (np.add.reduceat(regions["count"].astype("int64"), first_h) > 1)[of]
    hot = ((np.add.reduceat(other.astype("int64"), first_h) > hot_above) | (np.minimum.reduceat(regions["n"], first_h) == 0))[of]
    regions["count"][first] = np.minimum(np.add.reduceat(regions["count"].astype("int64"), first), 2**32 - 1)
    out = []
    for kind, chosen in ((0, np.flatnonzero(other & often & ~hot)), (1, np.flatnonzero(often & ~hot)), (2, np.flatnonzero(hot))):
        by = chosen[np.argsort(task[chosen], kind="stable")]
        for some in np.split(by, np.flatnonzero(np.diff(task[by])) + 1) if len(by) else []:
            blob = np.unique(regions["h"][some]) if kind == 2 else regions[some]
            out.append((part, kind, int(task[some[0]]), blob.tobytes()))
    return pd.DataFrame(out, columns=["part", "kind", "task", "blob"])


Folders = dict[str, tuple[str, int]]


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Folders]:
    """The texts as (id, text) in tasks that keep theirs, and the folders with the hot anchors and the runs of repeated windows for each task."""
    spark = docs.sparkSession
    texts = settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    tasks = max(1, texts.rdd.getNumPartitions())
    parts, local = 2 * tasks, LOCAL
    folder = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"

    def own_regions(batches: Iterator[pd.DataFrame], hot: np.ndarray, only_hot: bool) -> np.ndarray:
        held, size = [], 0
        for _, _, raw, starts in chunks(_texts(batches)):
            held.append(summed(anchors(raw, starts, hot, only_hot)[0]))
            size += len(held[-1])
            if size > 1_000_000:
                held = [summed(np.concatenate(held))]
                size = 0
        return summed(np.concatenate(held)) if held else np.zeros(0, REGION)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = crowded(own_regions(batches, NO_ANCHORS, False), local)
        if len(own):
            yield _split(own, TaskContext.get().partitionId(), parts)

    def count_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        split = _asked(hot, task, NO_ANCHORS.dtype)
        own = own_regions(batches if len(split) else iter(()), split, True)
        if len(own):
            yield _split(own, task, parts)

    def met_by_part(counts: Callable, hot_above: int) -> DataFrame:
        made = texts.mapInPandas(counts, "part int, task int, blob binary").groupBy("part")
        return cut(made.applyInPandas(lambda rows: meet(rows, hot_above), "part int, kind int, task int, blob binary"))

    met = met_by_part(count, HOT)
    hot = _ask(met.where("kind = 2").select("task", "blob"), f"{folder}/hot", tasks)
    if not met.where("kind = 2").isEmpty():
        met = met.where("kind < 2").unionByName(met_by_part(count_windows, 2**63 - 1))
    wanted = _ask(met.where("kind = 0").select("task", "blob"), f"{folder}/regions", tasks)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        ask, split = _asked(wanted, task, REGION), _asked(hot, task, NO_ANCHORS.dtype)
        ask = ask[np.argsort(ask["r"], kind="stable")]
        sent = np.zeros(len(ask), bool)
        for _, _, raw, starts in chunks(_texts(batches)):
            regions, lo = anchors(raw, starts, split)
            at = find(ask, regions)
            here = np.flatnonzero(at >= 0)
            here = here[~sent[at[here]]]
            here = here[np.unique(at[here], return_index=True)[1]]
            sent[at[here]] = True
            by: dict[int, list] = {}
            for k, place, start in zip((regions["h"][here] % np.uint64(parts)).tolist(), at[here].tolist(), lo[here].tolist()):
                found = ask[place]
                by.setdefault(k, []).append((found, raw[start : start + int(found["n"]) + SPAN - 1].tobytes()))
            rows = [(k, np.array([x for x, _ in some], REGION).tobytes(), b"".join(t for _, t in some)) for k, some in by.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["part", "heads", "bytes"])
        if not sent.all():
            raise ValueError("the texts of a task are not those of the first reading")

    def sort(mine: pd.DataFrame, whose: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"task": [], "blob": []}).astype({"task": "int32"})
        heads = np.concatenate([np.frombuffer(b, REGION) for b in mine["heads"]])
        whole = b"".join(mine["bytes"])
        sizes = heads["n"].astype("int64") + SPAN - 1
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.lexsort((heads["r"], heads["h"]))
        heads, begins, sizes = heads[order], begins[order], sizes[order]
        found: list[np.ndarray] = []
        a = 0
        while a < len(heads):
            b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), BLOCK)))
            while b < len(heads) and heads["h"][b] == heads["h"][b - 1]:
                b += 1
            texts_ = [whole[s : s + n] for s, n in zip(begins[a:b].tolist(), sizes[a:b].tolist())]
            region, first, last = repeats(texts_, heads["n"][a:b].astype("int64"), heads["count"][a:b] > 1)
            runs = np.zeros(len(region), RUN)
            runs["h"], runs["r"], runs["first"], runs["last"] = heads["h"][a + region], heads["r"][a + region], first, last
            found.append(runs)
            a = b
        runs = np.concatenate(found)
        runs = runs[np.lexsort((runs["first"], runs["r"]))]
        out: dict[int, list] = {}
        for task, blob in zip(whose["task"].tolist(), whose["blob"].tolist()):
            has = np.frombuffer(blob, REGION)
            has = np.sort(has["r"])
            keep = np.isin(runs["r"], has, assume_unique=False)
            if keep.any():
                out.setdefault(task, []).append(runs[keep])
        return _by_task(out)

    sent = texts.mapInPandas(send, "part int, heads binary, bytes binary")
    runs = sent.groupBy("part").cogroup(met.where("kind = 1").groupBy("part")).applyInPandas(sort, "task int, blob binary")
    return texts, {"hot": hot, "runs": _ask(runs, f"{folder}/runs", tasks)}


def spans(texts: Iterator[tuple], folders: Folders, task: int) -> Iterator[tuple]:
    """(id, bytes, removed parts) of each text of a task."""
    runs, hot = _asked(folders["runs"], task, RUN), _asked(folders["hot"], task, NO_ANCHORS.dtype)
    runs = runs[np.lexsort((runs["first"], runs["r"]))]
    for ids, raws, raw, starts in chunks(texts):
        regions, lo = anchors(raw, starts, hot)
        a, b = np.searchsorted(runs["r"], regions["r"], "left"), np.searchsorted(runs["r"], regions["r"], "right")
        by: dict[int, list] = {}
        hit = np.flatnonzero(b > a)
        docs = (np.searchsorted(starts, lo[hit], side="right") - 1).tolist()
        for k, doc in zip(hit.tolist(), docs):
            base = int(lo[k] - starts[doc])
            by.setdefault(doc, []).extend((base + int(x["first"]), base + int(x["last"])) for x in runs[a[k] : b[k]] if x["h"] == regions["h"][k])
        for k, (id_, text) in enumerate(zip(ids, raws)):
            yield id_, text, removed(len(text), by[k]) if k in by else []


def cut_out(text: bytes, parts: list[tuple[int, int]]) -> bytes:
    if not parts:
        return text
    edges = [0, *(x for p in parts for x in p), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, folders = marked(docs.withColumn(id_col, filled(F.col(id_col))), id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for id_, text, parts in spans(_texts(batches), folders, TaskContext.get().partitionId()):
            out.append((id_, len(text), sum(b - a for a, b in parts), len(parts), hashlib.sha256(cut_out(text, parts)).hexdigest()))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    made = texts.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.withColumn("doc_id", emptied(F.col("doc_id")))


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with repeats cut out of the text; all other columns stay. A character that is cut in two goes; null texts stay null."""
    schema, names = docs.schema, docs.columns
    others = F.struct(*[F.col(c) for c in names if c != text_col])
    texts, folders = marked(docs.select(others.alias("__rest"), text_col), "__rest", text_col)
    rest = texts.schema["id"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nulls: list[bool] = []

        def seen():
            for id_, text in _texts(batches):
                nulls.append(text is None)
                yield id_, text

        ids, kept = [], []
        for k, (id_, text, parts) in enumerate(spans(seen(), folders, TaskContext.get().partitionId())):
            ids.append(id_)
            kept.append(None if nulls[k] else cut_out(text, parts).decode("utf-8", "ignore"))
            if len(ids) >= 1000:
                yield pd.DataFrame({"id": ids, "text": kept})
                ids, kept = [], []
        if ids:
            yield pd.DataFrame({"id": ids, "text": kept})

    made = texts.mapInPandas(run, T.StructType([T.StructField("id", rest), T.StructField("text", T.StringType())]))
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col("id")[c].alias(c) for c in schema.names])
