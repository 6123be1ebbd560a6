"""The queries that apply each operator to its whole test table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, quality, sharding, simhash, suffix_dedup, token_counts, toxicity, url_rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_found FROM its JOIN ds USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_found, n_shingles, n_found / n_shingles AS containment FROM m JOIN n USING (item_id) WHERE n_found >= ceil(0.8 * n_shingles - 1e-9)
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op3_sql() -> str:
    """Histograms as lists; the last element of each is the total, from which the last class is made."""
    space, classes, langs = "[ \\t\\n\\x0B\\f\\r]", len(quality.CLASSES), sorted(quality.COMMON)
    quoted = lambda c: c.replace("'", "''")
    shares = {x: f"list_transform([{', '.join(f'common[{quality.WORDS.index(w) + 1}]' for w in ws)}], lambda x: x)" for x, ws in quality.COMMON.items()}
    of_refs = ", ".join(f"max(CASE WHEN lang = '{x}' THEN sums END) AS r_{x}, max(CASE WHEN lang = '{x}' THEN csums END) AS c_{x}" for x in langs)
    dist = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END))) / 2))"
    full = lambda own, n: f"list_transform(list_append({own}, {n} - list_sum({own})), lambda x: x / greatest({n}, 1)::DOUBLE)"
    own = lambda x, c: shares[x].replace("common[", f"{c}[")
    near_w = ", ".join(dist(full(own(x, "common"), "runs"), full(own(x, f"r_{x}"), f"r_{x}[{len(quality.WORDS) + 1}]")) for x in langs)
    near_c = ", ".join(dist(full(f"classes[1:{classes}]", f"classes[{classes + 1}]"), full(f"c_{x}[1:{classes}]", f"c_{x}[{classes + 1}]")) for x in langs)
    lists = lambda col, n: "[" + ", ".join(f"sum({col}[{k}])" for k in range(1, n + 1)) + "]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines,
  list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS runs FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: {{'pos': i, 'gram': array_to_string(words[i:i + 4], ' ')}})) AS g FROM w),
t AS (SELECT doc_id, g.pos AS pos, count(*) OVER (PARTITION BY doc_id, g.gram) AS n FROM g),
s AS (SELECT doc_id, least(5, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 5)) AS covers FROM t WHERE n > 1),
r AS (SELECT doc_id, sum(covers)::BIGINT AS n_repeat_words FROM s GROUP BY doc_id),
u AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(runs) AS run FROM w) WHERE run IN ({", ".join(f"'{x}'" for x in quality.WORDS)}) GROUP BY doc_id, run),
m AS (SELECT doc_id, map_from_entries(list({{'k': run, 'v': n}})) AS m FROM u GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(runs) AS runs,
  [{", ".join(f"len(regexp_extract_all(text, '{quoted(c)}'))" for c in quality.CLASSES)}, len(text)] AS classes,
  [{", ".join(f"coalesce(m['{x}'], 0)" for x in quality.WORDS)}, len(runs)] AS common
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
refs AS (SELECT {of_refs} FROM (SELECT lang, {lists("common", len(quality.WORDS) + 1)} AS sums, {lists("classes", classes + 1)} AS csums FROM b WHERE NOT base_failed GROUP BY lang)),
j AS (SELECT b.*, least({near_c}) AS class_distance, least({near_w}) AS word_distance FROM b, refs)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (len_chars >= {quality.LEAST_CHARS} AND class_distance > {quality.MOST_CHARS}) AND NOT (runs >= {quality.LEAST_WORDS} AND word_distance > {quality.MOST_WORDS} + 1 / sqrt(runs)) AS kept
FROM (SELECT *, classes[{classes + 1}] AS len_chars FROM j)
"""


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, nullif(last, page_id) AS refers_to
FROM p LEFT JOIN l USING (payload_digest)
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="start")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.page_id, arg_max(r.host || r.path, len(r.host) * 1000 + len(r.path)) AS rule, arg_max(r.verdict, len(r.host) * 1000 + len(r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_benchmark_decontamination, op3_quality_rules, op4_simhash_near_dedup, op5_sharding, op6_warc, op7_token_counts, op8_toxicity, op9_suffix_array_dedup, op10_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op3_quality_rules": _op3_sql(), "op6_warc": OP6_SQL, "op10_url_filters": OP10_SQL}
