import random

import corpus_pipeline
from loomgraph.llm import toxicity

from .test_decontaminate import has
from .test_packing import direct, laid_out
from .test_simhash import brute_components, plain


def cut(texts):
    """Texts without the bytes of 200-byte strings that are found twice."""
    from collections import Counter

    raws = [t.encode() for t in texts]
    seen = Counter(r[k : k + 200] for r in raws for k in range(len(r) - 199))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        out.append(bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_run(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items, shared = [prose(30) for _ in range(5)], prose(60)
    texts = [prose(rng.randint(5, 200)) for _ in range(150)]
    labels = []
    for k in range(150):
        if k % 5 == 0:
            texts[k] += " utter moron " + prose(5)
        labels.append((k, int(k % 5 == 0)))
    texts[11] = texts[12] = texts[13]
    texts[14] += " " + shared
    texts[16] += " " + shared + " end"
    texts[17] += " " + items[0]
    docs = [(k, t, "en", "s", len(t), k * 0.5) for k, t in enumerate(texts)] + [(200, "", "en", "s", 0, 0.0), (201, None, None, None, 0, 0.0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, piece double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.learned(read, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(d[0], d[1]) for d in docs if max(model.raw(toxicity.words_of(d[1])), default=model.bias) < model.middle]
    assert len(left) < 140
    roots = brute_components([i for i, _ in left], [plain(t) for _, t in left])
    left = [(i, t) for (i, t), r in zip(left, roots) if i == r]
    left = list(zip([i for i, _ in left], cut([t or "" for _, t in left])))
    left = [(i, t) for i, t in left if not any(has(t, x) for x in items)]
    ids = {i: i for i, _ in left}
    assert {11, 14, 16} <= set(ids) and not {12, 13, 17} & set(ids)
    from loomgraph.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in got) == sorted((i, 0, len(direct(path, t))) for i, t in left)
    laid_out(got)


def written(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_null_and_repeated_ids_and_clashing_names(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    texts = [prose(40) for _ in range(6)]
    item = prose(30)
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2] + " " + item), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4]), (7, item), (9, None), (None, ""), (10, texts[5])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __leak string")
    for name in ("__keep", "__key", "key", "n", "table", "u", "v", "piece", "sequence_id", "part", "task", "id", "lang"):
        docs = docs.withColumn(name, docs["__leak"])
    folder = written(spark, tmp_path, docs, [], [(0, item), (None, None), (None, "")])
    got = corpus_pipeline.run(spark, folder).collect()
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got)
    assert kept == [-1, -1, 7, 7, 9, 10]  # each text once, texts without words once, nothing with the item
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    laid_out(got)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, written(spark, tmp_path, docs, [], [])).count() == 0
