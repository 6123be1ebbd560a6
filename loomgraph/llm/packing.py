"""Best-fit packing of tokenised documents into fixed-length training sequences.

Bounded-space online best-fit: a task keeps a fixed number of open bins. A bitset has bit f set while some open bin has f
free tokens, so the tightest bin for n tokens is the lowest set bit at or above n. When all bins are open and none fits, the
fullest (lowest set bit) closes. What the open bins of FAN_IN tasks hold at the end goes through a second pass of the same
kind, whose fixed number of open bins is that of these tasks together; there longer pieces arrive first. A pass streams
its rows: no more than the pieces of its open bins is held. Up to MOST_TASKS tasks pack; beyond that they have more rows each.

Results for odd inputs: a null or empty text has the end token alone, and so is one piece of length 1; an empty table gives no
rows; repeated rows are documents of their own; null ids are kept. Any text length works: a piece holds at most `capacity`
tokens. Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, emptied, filled, task_memory, tasks_for

CAPACITY = 4096
OPEN_BINS = 128
FAN_IN = 32
ROWS_PER_TASK = 32_000
MOST_TASKS = 20_000
CACHED_WORDS = 400_000
CACHED_CHARS = 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ranked:
    """Ids of new words by the ranked-merge engine of another library, for a tokenizer file of the usual kind: lower-cased words, byte-level
    merges and an end-of-word suffix. The suffix becomes a zero byte that ends each pre-token, merged before all else.

    Only for words of Latin letters, digits and signs below U+0180, on which both engines agree; checked on PROBES when it is made.
    """

    WORD = re.compile("[!-\u00b4\u00b6-\u012f\u0131-\u0148\u014a-\u017e]+")
    PROBES = ["the", "it's", "we'll've", "a1b22", "!!?", "Étrangère,", "über|Straße", "x" * 40, "'s't", "\u00ab\u00bb12\u00bd", "<|end", "ñandú."]

    def __init__(self, path: str, tokenizer):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["dropout"] or [x["type"] for x in parts["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("another kind of tokenizer")
        self.pattern = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): b for b, c in zip(shown + [b for b in range(256) if b not in shown], shown + list(range(256, 324)))}
        raw = lambda token: bytes(byte[c] for c in token.removesuffix("</w>")) + (b"\0" if token.endswith("</w>") else b"")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(1, 256)}
        for k, pair in enumerate(model["merges"]):
            ranks[raw("".join(pair if isinstance(pair, list) else pair.split(" ")))] = 512 + k
        special = {x["content"] for x in parts["added_tokens"]}
        ids = {raw(t): k for t, k in model["vocab"].items() if t not in special}
        self.ids, self.ends = np.zeros(max(ranks.values()) + 1, "<u4"), np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            self.ids[rank], self.ends[rank] = ids[token], token.endswith(b"\0")
        self.engine = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        if not all("<|" in x for x in special) or any(self.of([w])[0] != np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in self.PROBES):
            raise ValueError("the engines differ")

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of each word; "<|" is not to be in any, as it may begin a special token."""
        parts, counts = [], []
        for w in words:
            w = w.lower()
            if w.isalpha():
                parts.append(w)
                counts.append(1)
            else:
                own = self.pattern.findall(w)
                parts += own
                counts.append(len(own))
        tokens = np.array(self.engine.encode_ordinary("\0".join([*parts, ""])), "int64")
        bounds = np.concatenate([[0], (np.flatnonzero(self.ends[tokens]) + 1)[np.cumsum(counts) - 1] * 4]).tolist()
        raw = self.ids[tokens].tobytes()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, for a tokenizer whose tokens never cross white space.

    Ids of words are kept in a bounded dictionary, which most words of a text hit. Texts with control characters, which Python
    and the tokenizer may split differently, are encoded as they are.
    """

    ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        try:
            self.ranked = Ranked(path, self.tokenizer)
        except (KeyError, ValueError):  # another kind of tokenizer: all words go through it
            self.ranked = None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [None if self.ODD.search(t) else t.split() for t in texts]
        words = self.words
        new = [w for w in set().union(*(w for w in split if w)) if w not in words]
        plain = self.ranked and self.ranked.WORD.fullmatch
        simple = [w for w in new if plain and plain(w) and len(w) < 400 and "<|" not in w]
        for k in range(0, len(simple), 8192):
            words.update(zip(simple[k : k + 8192], self.ranked.of(simple[k : k + 8192])))
        other = [w for w in new if w not in words]
        for k in range(0, len(other), 1024):
            words.update(zip(other[k : k + 1024], self.whole(other[k : k + 1024])))
        get = words.__getitem__
        for t, w in zip(texts, split):
            yield self.whole([t])[0] if w is None else b"".join(map(get, w))
        room = len(new) + CACHED_WORDS - len(words)
        for w in (w for k, w in enumerate(new) if k >= room or len(w) > CACHED_CHARS):
            del words[w]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker; its words are those of one task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document of at most `capacity` tokens; its ids too, if asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        with task_memory(enc.words):
            for batch in batches:
                yield from cut_up(enc, batch)

    def cut_up(enc: WordEncoder, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], "<u4").tobytes()
        ids = batch["doc_id"].tolist()
        texts = ["" if t is None else t for t in batch["text"].tolist()]
        groups, size = [0], 0
        for k, t in enumerate(texts):  # a few MB at a time
            size += len(t)
            if size > 4_000_000:
                groups.append(k + 1)
                size = 0
        for a, b in zip(groups, [*groups[1:], len(texts)]):
            rows = []
            for doc, raw in zip(ids[a:b], enc.encode(texts[a:b])):
                raw += end
                for n, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    rows.append((doc, n, s // 4, len(part) // 4, zlib.crc32(part), *((np.frombuffer(part, "<u4"),) if with_ids else ())))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    narrow = docs.select(filled(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = narrow.mapInPandas(run, PIECES + (", ids array<int>" if with_ids else ""))
    return made.withColumn("doc_id", emptied(F.col("doc_id")))


class OpenBins:
    """At most `limit` open bins of `capacity`, found by their free space through a bitset."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.mask, self.n, self.made = 0, 0, 0
        self.by_free: dict[int, list] = defaultdict(list)

    def _take(self, free: int) -> tuple[int, list]:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.n -= 1
        return found

    def add(self, item, length: int) -> list[tuple[int, list]]:
        """Place an item; the bins that this closes, as (number, [(item, offset), ...])."""
        closed = []
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n >= self.limit:
                closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, bin_ = self.capacity, (self.made, [])
            self.made += 1
        bin_[1].append((item, self.capacity - free))
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.mask |= 1 << left
            self.n += 1
        else:
            closed.append(bin_)
        return closed

    def rest(self) -> list[tuple[int, list]]:
        out = [b for bins in self.by_free.values() for b in bins]
        self.by_free.clear()
        self.mask = self.n = 0
        return sorted(out)


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """items (PIECES, written by an earlier step) with sequence_id and offset.

    The order of arrival is a hash of the keys, and in the second pass the length; it is the same when a lost task runs again.
    """
    rows = items.count()
    n = tasks_for(rows, max(rows_per_task, rows // MOST_TASKS))
    items = items.withColumn("doc_id", filled(F.col("doc_id")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "team long, " + PIECES + ", sequence_id long, offset long"
    order = F.xxhash64("doc_id", "piece", "ids_crc32")

    def online(limit: int, odd: int, last: bool) -> Callable:
        """Bounded-space best fit over the rows of each team as they come; what is open at a team's end closes if this is the last pass."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            team, bins, out = None, OpenBins(capacity, limit), []

            def close(closed: list, final: bool) -> None:
                out.extend((team, *item, ((team << 32 | k) * 2 + odd) if final else None, at if final else None) for k, placed in closed for item, at in placed)

            def frame() -> pd.DataFrame:
                rows = pd.DataFrame(out, columns=["team", *columns, "sequence_id", "offset"]).astype({"sequence_id": "Int64", "offset": "Int64"})
                out.clear()
                return rows

            for batch in batches:
                for own, *item in zip(*(batch[c].tolist() for c in ("team", *columns))):
                    if own != team:
                        close(bins.rest(), last)
                        team, bins = own, OpenBins(capacity, limit)
                    close(bins.add(tuple(item), item[3]), True)
                yield frame()
            close(bins.rest(), last)
            yield frame()

        return run

    dealt = items.repartition(n, F.xxhash64("doc_id", "piece")).sortWithinPartitions(order, *columns).withColumn("team", F.spark_partition_id().cast("long"))
    first = cut(dealt.select("team", *columns).mapInPandas(online(open_bins, 0, False), schema))
    open_ = first.where(F.col("sequence_id").isNull()).withColumn("team", F.expr(f"team div {FAN_IN}"))
    open_ = open_.repartition(tasks_for(n, FAN_IN), "team").sortWithinPartitions("team", F.desc("length"), order, *columns)
    again = open_.select("team", *columns).mapInPandas(online(FAN_IN * open_bins, 1, True), schema)
    both = first.where(F.col("sequence_id").isNotNull()).unionByName(again)
    return both.select(emptied(F.col("doc_id")).alias("doc_id"), *columns[1:], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document lies: PIECES, sequence_id, offset."""
    return pack(cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training rows themselves: sequence_id, doc_ids and token ids in order. A sequence is bounded by `capacity`."""
    at = pack_documents(docs, tokenizer, capacity, end_id, id_col, text_col).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    at = at.dropDuplicates(["sequence_id", "offset"]).withColumn("copy", F.expr("row_number() over (partition by doc_id, piece, ids_crc32 order by sequence_id, offset)"))
    ids = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids=True).withColumn("copy", F.expr("row_number() over (partition by doc_id, piece, ids_crc32 order by length)"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "piece", "ids_crc32", "copy")]
    both = at.alias("a").join(ids.alias("b"), same[0] & same[1] & same[2] & same[3])
    rows = both.groupBy("a.sequence_id").agg(F.array_sort(F.collect_list(F.struct("a.offset", "a.doc_id", "b.ids"))).alias("parts"))
    return rows.select("sequence_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"))
