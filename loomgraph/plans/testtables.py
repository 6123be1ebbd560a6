"""The engine's tables made from the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()
PATH = "CASE {} % 5 WHEN 0 THEN 'core/src/r0.rs' WHEN 1 THEN 'web/ui/r1.ts' WHEN 2 THEN 'lib/tests/r2.py' WHEN 3 THEN 'core/src/r3_test.rs' ELSE 'app/r4.svelte' END"
TABLES = {
    "raw_nodes": f"""
      SELECT CAST(r_regionkey AS BIGINT) AS ord, 'FILE:' || {PATH.format('r_regionkey')} AS id, 'File' AS type, {PATH.format('r_regionkey')} AS name, 1 AS lineno, 1 AS end_lineno, 100 AS token_count, '' AS docstring, '' AS signature, CAST(NULL AS STRING) AS trait_impl FROM region
      UNION ALL SELECT 1000 + n_nationkey, 'FILE:' || {PATH.format('n_regionkey')} || '::Nation' || CAST(n_nationkey AS STRING), 'Class', 'Nation' || CAST(n_nationkey AS STRING), CAST(n_nationkey * 10 AS INT), CAST(n_nationkey * 10 + 9 AS INT), 50, n_name, '', NULL FROM nation
      UNION ALL SELECT 1000000 + s_suppkey, 'FILE:' || {PATH.format('n_regionkey')} || '::Nation' || CAST(s_nationkey AS STRING) || '::m' || CAST(s_suppkey % 7 AS STRING), 'Method', 'm' || CAST(s_suppkey % 7 AS STRING), CAST(s_suppkey % 90 AS INT), CAST(s_suppkey % 90 + 5 AS INT), CAST(s_suppkey % 80 AS INT), s_name, 'fn m(self)', CASE s_suppkey % 3 WHEN 0 THEN 'Display' WHEN 1 THEN 'Iterator' END FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT 1000000000 + c_custkey, 'FILE:' || {PATH.format('n_regionkey')} || '::customer_' || CAST(c_custkey AS STRING), 'Function', CASE WHEN c_custkey % 50 = 7 THEN 'test_' ELSE '' END || 'customer_' || CAST(c_custkey AS STRING), CAST(c_custkey % 500 AS INT), CAST(c_custkey % 500 + 9 AS INT), CAST(c_custkey % 90 + 10 AS INT), c_mktsegment, 'fn customer()', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 1000000000000 + p_partkey, 'FILE:' || {PATH.format('p_partkey')} || '::PART_' || CAST(p_partkey AS STRING), 'Constant', 'PART_' || CAST(p_partkey AS STRING), p_size, p_size, 1, p_type || ' ' || p_name, '', NULL FROM part""",
    "nodes": "SELECT ord, id, type, name, lineno, end_lineno, token_count, docstring, signature, trait_impl FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM raw_nodes) t WHERE rn = 1",
    "ctx": f"""SELECT c_custkey AS ck, 'FILE:' || {PATH.format('n_regionkey')} || '::customer_' || CAST(c_custkey AS STRING) AS cid, 'FILE:' || {PATH.format('n_regionkey')} || '::Nation' || CAST(c_nationkey AS STRING) AS nid FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "stx": f"""SELECT s_suppkey AS sk, s_nationkey AS snk, 'FILE:' || {PATH.format('n_regionkey')} || '::Nation' || CAST(s_nationkey AS STRING) AS snid, s_suppkey % 7 AS mk FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "edges": f"""
      SELECT CAST(n_nationkey AS BIGINT) AS ord, 'FILE:' || {PATH.format('n_regionkey')} AS source, 'FILE:' || {PATH.format('n_regionkey')} || '::Nation' || CAST(n_nationkey AS STRING) AS target, 'DEFINES' AS relation, CAST(NULL AS INT) AS lineno FROM nation
      UNION ALL SELECT 1000 + a.n_nationkey, 'FILE:' || {PATH.format('a.n_regionkey')} || '::Nation' || CAST(a.n_nationkey AS STRING), 'FILE:' || {PATH.format('b.n_regionkey')} || '::Nation' || CAST(b.n_nationkey AS STRING), 'INHERITS', NULL FROM nation a JOIN nation b ON b.n_nationkey = CAST(floor(a.n_nationkey / 2) AS INT) WHERE a.n_nationkey > 0
      UNION ALL SELECT 1000000 + sk, snid, snid || '::m' || CAST(mk AS STRING), 'DEFINES', NULL FROM stx
      UNION ALL SELECT 1000000000 + ck, nid || '::m' || CAST(ck % 7 AS STRING), cid, 'CALLS_RESOLVED', CAST(ck % 100 AS INT) FROM ctx
      UNION ALL SELECT 1000000000000 + ((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey, cid,
        CASE WHEN l_orderkey % 3 > 0 THEN snid || '::m' || CAST(mk AS STRING) WHEN l_partkey % 5 = 0 THEN 'REF:m' || CAST(mk AS STRING) WHEN l_partkey % 5 = 1 THEN 'REF:Nation' || CAST(snk AS STRING) || '::m' || CAST(mk AS STRING)
          WHEN l_partkey % 5 = 2 THEN 'REF:self.customer_' || CAST(ck AS STRING) WHEN l_partkey % 5 = 3 THEN 'REF:Vec::new' ELSE 'REF:std::mem::swap' END,
        CASE WHEN l_orderkey % 3 > 0 THEN 'CALLS_RESOLVED' ELSE 'CALLS' END, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ctx ON o_custkey = ck JOIN stx ON l_suppkey = sk""",
    "docs": "SELECT doc_id AS ord, 'FILE:' || source || '/' || lang || '/' || CAST(doc_id AS STRING) AS id, CASE doc_id % 4 WHEN 0 THEN 'File' WHEN 1 THEN 'Function' WHEN 2 THEN 'Class' ELSE 'Constant' END AS type, regexp_extract(lower(text), '[a-z]+', 0) AS name, text AS docstring, 'fn ' || lang AS signature, source AS crate, lang, n_chars % 7 AS in_degree, doc_id % 5 = 0 AS is_test FROM documents",
    "vecs": "SELECT 'v' || CAST(vec_id AS STRING) AS id, vec_id, embedding AS vector, CASE label % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'Class' ELSE 'File' END AS type, vec_id % 11 AS in_degree FROM embeddings",
    "lines": "SELECT CAST(user_id AS STRING) || '@' || CAST(CAST(ts AS DATE) AS STRING) AS sha, 'u' || CAST(user_id % 13 AS STRING) AS author, CAST(CAST(ts AS DATE) AS STRING) AS day, 'f' || CAST(event_id % 100 AS STRING) AS file, CAST(event_id * 7 % 60 + 1 AS INT) AS line, CASE event_id % 3 WHEN 0 THEN '-' ELSE '+' END AS sign, event_id, event_type FROM events",
    "spans": "SELECT 'f' || CAST(p_partkey % 100 AS STRING) AS file, p_size AS start, CAST(p_size + p_partkey % 23 AS INT) AS \"end\", 'P' || CAST(p_partkey AS STRING) AS id, p_partkey AS ord FROM part",
    "requests": "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN page_id % 4 = 0 THEN '/api/v1' WHEN page_id % 4 = 1 THEN '/api' ELSE '' END || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') AS path FROM pages",
    "endpoints": "SELECT CAST(n_nationkey AS BIGINT) AS ord, CASE n_nationkey % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, CASE n_nationkey % 6 WHEN 0 THEN '/en/{id}' WHEN 1 THEN '/{lang}/{id}' WHEN 2 THEN '/fr/{id}' WHEN 3 THEN '/{lang}/{id}/' WHEN 4 THEN '/de/' || CAST(n_nationkey AS STRING) || '.html' ELSE '/x/{id}' END AS path, 'm' || CAST(n_nationkey % 9 AS STRING) AS operation, CASE n_nationkey % 2 WHEN 0 THEN 'Users' ELSE 'Admin' END AS tag FROM nation",
}


_made: dict[tuple[str, str], dict[str, DataFrame]] = {}


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The test tables and the engine's tables, as lazy DataFrames; analysed once for each application and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key in _made:
        return _made[key]
    found = {}
    for name in BASE:
        found[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        found[name].createOrReplaceTempView(name)
    for name, sql in TABLES.items():
        found[name] = spark.sql(sql.replace('"end"', "`end`"))
        found[name].createOrReplaceTempView(name)
    _made[key] = found
    return found


def oracle(sql: str) -> str:
    """SQL with the engine's tables in front of it."""
    first = ",\n".join(f"{name} AS ({body})" for name, body in TABLES.items())
    return f"WITH RECURSIVE {first},\n{sql.strip().removeprefix('WITH ')}" if sql.strip().startswith("WITH ") else f"WITH RECURSIVE {first}\n{sql}"
