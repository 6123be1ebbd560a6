"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is in a document if the document has at least `least` of the item's distinct word shingles. Items are partitioned by
size (the power of two above their number of distinct shingles). In a partition, the sketch of an item of n shingles is its
n - ceil(least * n) + 1 smallest shingle hashes (bottom-k MinHash), and the sketch of a document is all its shingle hashes up to
the partition's bound, the largest hash in any of its items' sketches (MinHash of a fixed rate, as documents are of any length). A
document that contains the item lacks at most n - ceil(least * n) shingles, so the two sketches share a hash for certain: no
pair is lost, however long the document. Only partitions whose items are small enough for the document to hold are searched.
Candidate pairs are then verified by counting the item's shingles among the document's, by their words.

Words are runs of letters, digits and underscores, lower-cased. An item of fewer words than a shingle has one shingle of all its
words; an item without words is in no document.

The sketches and shingles of at most ITEMS_AT_ONCE items and CHARS_AT_ONCE characters are broadcast (about 0.3 MB for 1000 items of
40 words); a larger benchmark takes several passes over the documents, whose pairs add up.

Results for odd inputs: a null or empty text holds no item; null ids are kept; repeated documents and items give a row for each pair; an empty
table on either side gives no rows; texts of any length are searched whole. Only the id and text columns are read. without_items
decides each row by its own text, so rows that share an id, or have none, stand for themselves, and other columns may have any names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emptied, filled, task_memory

WORDS = 5
LEAST = 0.8
ITEMS_AT_ONCE = 20_000
CHARS_AT_ONCE = 16_000_000
FILTER_BITS = 22
WORD = re.compile(r"\w+")
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
CACHED_WORDS = 300_000
_hashes: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    found = _hashes.get(word)
    if found is None:
        found = xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(_hashes) < CACHED_WORDS:
            _hashes[word] = found
    return found


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, from the words' hashes."""
    if len(hashes) < n:
        return np.zeros(0, "u8")
    out = np.zeros(len(hashes) - n + 1, "u8")
    for k in range(n):
        h = hashes[k : len(hashes) - n + 1 + k]
        out = (out ^ h ^ (h >> np.uint64(29))) * _MULTIPLY[k % 5]
        out ^= out >> np.uint64(32)
    return out


class Items:
    """Sketches of items by size partition, and their shingles."""

    def __init__(self, items: list[tuple], words: int, least: float):
        self.words, self.ids, self.shingles, self.need, self.cache = words, [], [], [], _hashes
        self.partitions: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            n = min(words, len(w))
            h = shingle_hashes(np.array([word_hash(x) for x in w], "u8"), n)
            own = {}
            for k, x in enumerate(h.tolist()):
                own.setdefault(tuple(w[k : k + n]), x)
            k, need = len(self.ids), ceil(least * len(own) - 1e-9)
            self.ids.append(item)
            self.shingles.append((n, own))
            self.need.append(need)
            part = self.partitions[n, (len(own) - 1).bit_length()]
            for x in sorted(set(own.values()))[: len(own) - need + 1]:
                part[x].append(k)
        self.lengths = sorted({n for n, _ in self.partitions})
        self.least_of = {p: min(self.need[k] for ks in hashes.values() for k in ks) for p, hashes in self.partitions.items()}
        self.bound = {p: np.uint64(max(hashes)) for p, hashes in self.partitions.items()}
        self.filter = {n: np.zeros(1 << FILTER_BITS, bool) for n in self.lengths}
        for (n, _), hashes in self.partitions.items():
            self.filter[n][(np.fromiter(hashes, "u8", len(hashes)) >> np.uint64(64 - FILTER_BITS)).astype("int64")] = True

    def sketches(self, h: np.ndarray, n: int) -> dict[tuple[int, int], list[int]]:
        """For each partition whose items a document of the shingle hashes h may hold: the document's sketch, without hashes that no item's sketch can have."""
        known = h[self.filter[n][(h >> np.uint64(64 - FILTER_BITS)).astype("int64")]]
        return {p: known[known <= self.bound[p]].tolist() for p in self.partitions if p[0] == n and self.least_of[p] <= len(h)} if len(known) else {}

    def found_in(self, text: str | None) -> list[tuple[int, int]]:
        """(item's number, shingles found) of each item that the text contains."""
        w = words_of(text)
        hashes = np.fromiter(map(word_hash, w), "u8", len(w))
        out = []
        for n in self.lengths:
            h = shingle_hashes(hashes, n)
            candidates = {k for p, sketch in self.sketches(h, n).items() for x in sketch for k in self.partitions[p].get(x, ())}
            if candidates:
                there = {tuple(w[k : k + n]) for k in range(len(h))}
                for k in sorted(candidates):
                    found = sum(s in there for s in self.shingles[k][1])
                    if found >= self.need[k]:
                        out.append((k, found))
        return out


def passes(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, at_once: int) -> Iterator:
    """Broadcasts of the benchmark, at_once items and CHARS_AT_ONCE characters at most in each (or one item)."""
    sc, held, chars = docs.sparkSession.sparkContext, [], 0
    stated = items.select(filled(F.col(item_col)), F.col(item_text_col).cast("string")).where(F.col(item_text_col).isNotNull())
    for r in stated.toLocalIterator():
        if held and (len(held) == at_once or chars + len(r[1]) > CHARS_AT_ONCE):
            yield sc.broadcast(held)
            held, chars = [], 0
        held.append(tuple(r))
        chars += len(r[1])
    if held:
        yield sc.broadcast(held)


def contained(docs: DataFrame, items: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """doc_id, item_id, n_found, n_shingles, containment of every pair with a containment of at least `least`."""
    schema = "doc_id long, item_id long, n_found long, n_shingles long, containment double"
    rows = docs.select(filled(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one_pass(shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Items(shared.value, words, least)
            with task_memory(known.cache):
                for batch in batches:
                    out = []
                    for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                        for k, found in known.found_in(text):
                            n = len(known.shingles[k][1])
                            out.append((doc, known.ids[k], found, n, found / n))
                    if out:
                        yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_found", "n_shingles", "containment"])

        return rows.mapInPandas(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for k, shared in enumerate(passes(docs, items, item_col, item_text_col, at_once)):
        out = out.unionByName(one_pass(shared)) if k else one_pass(shared)
    return out.withColumns({"doc_id": emptied(F.col("doc_id")), "item_id": emptied(F.col("item_id"))})


def without_items(docs: DataFrame, items: DataFrame, words: int = WORDS, least: float = LEAST, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of docs whose text contains none of the items; all columns stay. Rows are judged where they are read, without a shuffle."""

    def clean_of(shared):
        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = Items(shared.value, words, least)
            with task_memory(known.cache):
                for texts in batches:
                    yield pd.Series([not known.found_in(t) for t in texts.tolist()], dtype="bool")

        return clean

    for shared in passes(docs, items, item_col, item_text_col, at_once):
        docs = docs.where(clean_of(shared)(F.col(text_col).cast("string")))
    return docs
