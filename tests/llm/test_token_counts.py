import public_tokenizers as P
import pytest

from loomgraph.llm import queries, token_counts

PATH, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
TEXTS = ["", None, "one", "\n", "a\n\nb  \n c", "Öl, l'été 日本語 🙂🙂\nñandú\r\nx", "word " * 3000 + "\n" + "y" * 5000, "é\n" * 50, "﻿\x00\n z"]


def brute(parts, joint, rule):
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = joint.join(parts)
    owner = [n for n, p in enumerate(parts) for _ in range(len(p) + (len(joint) if n < len(parts) - 1 else 0))]
    out = [0.0] * len(parts)
    at = [n for n, c in enumerate(text) for _ in c.encode()]
    used = 0
    raw = {b: n for n, b in byte_table().items()}
    for token in k.encode(text, add_special_tokens=False).tokens:
        size = len([raw[c] for c in token])
        chars = sorted(set(at[used : used + size]))
        used += size
        owners = [owner[c] for c in chars]
        if rule == "start":
            out[owners[0]] += 1
        elif rule == "most":
            out[max(dict.fromkeys(owners), key=owners.count)] += 1
        else:
            for o in owners:
                out[o] += 1 / len(owners)
    return out


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip(shown + [b for b in range(256) if b not in shown], map(chr, shown + list(range(256, 256 + 68)))))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines(spark, rule):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1), (None, "a\nb", 1)], "doc_id long, text string, part int")
    got = {}
    for r in token_counts.counts(docs, PATH, PATTERN, rule).collect():
        got.setdefault(r["doc_id"], []).append((r["part"], r["n_chars"], r["n_tokens"]))
    for k, t in enumerate(TEXTS):
        parts = (t or "").split("\n")
        rows = sorted(got[k])
        assert [r[:2] for r in rows][:: 2 if k == 2 else 1] == [(n, len(p)) for n, p in enumerate(parts)]
        assert [r[2] for r in rows][:: 2 if k == 2 else 1] == pytest.approx(brute(parts, "\n", rule))
    assert len(got[2]) == 2 and len(got[None]) == 2
    assert token_counts.counts(docs.limit(0), PATH, PATTERN, rule).count() == 0


def test_fields(spark):
    rows = [(1, "user", "Hello there"), (2, None, "x"), (3, "é", "")]
    df = spark.createDataFrame(rows, "conv_id long, role string, text string")
    got = token_counts.counts(df, PATH, PATTERN, "most", "conv_id", ("role", "text"), joint=": ").collect()
    for c, role, text in rows:
        own = sorted((r["part"], r["field"], r["n_tokens"]) for r in got if r["doc_id"] == c)
        assert [o[1] for o in own] == ["role", "text"]
        assert [o[2] for o in own] == brute([role or "", text], ": ", "most")


@pytest.mark.parametrize("rule", ["start", "share"])
def test_long_runs(spark, monkeypatch, rule):
    big = 2_000_000
    texts = [" " * big, "a" + "\n" * 3, "x\t" * 3 + "\t" * big + "y", "b " + " " * big + " c", " " * big + "\n", "\u3000\xa0" * 40_000 + "z", "q" * big]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, "\n" * 300_000 + "end")], "doc_id long, text string")
    got = token_counts.counts(docs, PATH, PATTERN, rule).groupBy("doc_id").agg({"n_tokens": "sum", "n_chars": "sum", "part": "max"}).collect()
    assert {r["doc_id"]: r["sum(n_chars)"] + r["max(part)"] for r in got} == {k: len(t) for k, t in enumerate(texts)} | {9: 300_003}
    monkeypatch.setattr(token_counts, "LONG_RUN", __import__("re").compile(f"[{token_counts.SPACES}]{{3,}}"))
    encoding, _ = token_counts.vocabulary(PATH, PATTERN)
    for text in ["a   b", "   ", " \t\n x\r\n\r\n", "w" + " " * 900 + "é" + "\n" * 700, "\x85\xa0 \u2028\u3000  v", "\x1c\x1d\x1e   \x1f"]:
        assert token_counts.token_ids(text, encoding) == encoding.encode_ordinary(text)


def test_whole_table(spark):
    got = queries.op7_token_counts(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoding, _ = token_counts.vocabulary(PATH, PATTERN)
    want = {r["doc_id"]: len(encoding.encode_ordinary(r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()} == want
