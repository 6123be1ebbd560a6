import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm import packing, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path("word_bpe_49k.json")


ODD = ["", None, "a", "Wörld  it's e\u0301t ÉÈ <|endoftext|> x\x01y \x85z\u2028q", "tab\x1cbed 12 3.14 !!?? 'll", "the " * 9000, "İstanbul ΑΣ ﬁ"]


def direct(path, text):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, 1]


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_encoder_gives_the_tokenizers_ids(path):
    import pyarrow.parquet as pq

    texts = [t or "" for t in [*ODD, *pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:300]]]
    enc = packing.WordEncoder(path)
    for _ in range(2):
        for t, raw in zip(texts, enc.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == direct(path, t)[:-1]


def test_ranked_words_are_the_tokenizers(path):
    rng = random.Random(1)
    enc = packing.WordEncoder(path)
    letters = [chr(c) for c in range(33, 0x180)]
    words = letters + ["".join(rng.choice([rng.choice(letters), chr(rng.randrange(97, 123))]) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    words = [w for w in words if enc.ranked.WORD.fullmatch(w) and "<|" not in w]
    assert len(words) > 10_000
    for w, raw in zip(words, enc.ranked.of(words)):
        assert np.frombuffer(raw, "<u4").tolist() == direct(path, w)[:-1], w


def test_bounded_dictionary(path, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    enc = packing.WordEncoder(path)
    texts = ["the cat sat on the mat", "a dog and a cat", "q" * 50 + " the", "the cat sat on the mat again"]
    for t in texts * 2:
        assert np.frombuffer(next(iter(list(enc.encode([t])))), "<u4").tolist() == direct(path, t)[:-1]
        assert len(enc.words) <= 5


def test_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.add("a", 6) == [] and bins.add("b", 7) == []
    assert bins.add("c", 3) == [(1, [("b", 0), ("c", 7)])]
    assert bins.add("d", 5) == []
    assert bins.add("e", 8) == [(0, [("a", 0)])]
    assert bins.rest() == [(2, [("d", 0)]), (3, [("e", 0)])]


def laid_out(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_pack_odd_rows(spark, path):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").cache()
    got = packing.pack_documents(docs, path).collect()
    laid_out(got)
    want = []
    for k, t, _ in rows:
        ids = direct(path, t)
        for n, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want.append((k, n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    whole = packing.sequences(docs, path).collect()
    assert sum(len(r["input_ids"]) for r in whole) == sum(r[3] for r in want)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_few_sequences(spark):
    got = queries.op1_best_fit_packing(spark, SF).collect()
    used = laid_out(got)
    tokens = sum(r["length"] for r in got)
    assert used <= 1.02 * -(-tokens // 4096) + 2
