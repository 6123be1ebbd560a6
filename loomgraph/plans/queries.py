"""One query for each operator over the test tables, beside the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.operators import crosslang, flow, graph, history, resolve, search
from loomgraph.streaming import churn

from .testtables import oracle, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CALLED = "('CALLS', 'CALLS_RESOLVED', 'INSTANTIATES', 'INSTANTIATES_RESOLVED')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


@query("SELECT ord, id, name FROM nodes")
def node_dedup(t):
    return graph.first_of(t["raw_nodes"], ["id"]).select("ord", "id", "name")


@query("SELECT n.id, coalesce(c.n, 0) AS in_degree FROM nodes n LEFT JOIN (SELECT target, count(*) AS n FROM edges GROUP BY target) c ON c.target = n.id")
def in_degree(t):
    return graph.in_degree(t["nodes"], t["edges"]).select("id", "in_degree")


@query("SELECT source AS id, count(*) AS out_degree FROM edges GROUP BY source")
def out_degree(t):
    return graph.out_degree(t["edges"])


@query(f"""WITH hit AS (SELECT DISTINCT source AS id FROM edges WHERE relation IN {CALLED} AND (target IN ('m3', 'REF:m3') OR target IN (SELECT id FROM nodes WHERE name = 'm3' OR ends_with(id, '::m3')) OR (starts_with(target, 'REF:') AND (ends_with(target, '::m3') OR ends_with(target, '.m3')))))
SELECT id, name, type, token_count FROM hit LEFT JOIN nodes USING (id) ORDER BY id LIMIT 20""")
def callers(t):
    return graph.callers(t["nodes"], t["edges"], "m3")


@query(f"""SELECT DISTINCT source AS id FROM edges WHERE relation IN {CALLED} AND (target IN ('m1', 'REF:m1') OR target IN (SELECT id FROM nodes WHERE name = 'm1' OR ends_with(id, '::m1')) OR (starts_with(target, 'REF:') AND (ends_with(target, '::m1') OR ends_with(target, '.m1'))))""")
def callers_all(t):
    return graph.callers(t["nodes"], t["edges"], "m1", None).select("id")


@query("""WITH s AS (SELECT id FROM nodes WHERE name = 'customer_4' AND type IN ('Function', 'Method') ORDER BY ord LIMIT 1),
c AS (SELECT ord, CASE WHEN starts_with(target, 'REF:') THEN 'REF:' || CASE WHEN target LIKE '%::%' THEN substr(target, 5) WHEN target LIKE '%.%' THEN regexp_extract(target, '([a-z_0-9]+)$', 1) ELSE substr(target, 5) END ELSE target END AS callee FROM edges WHERE source IN (SELECT id FROM s) AND relation IN ('CALLS', 'CALLS_RESOLVED'))
SELECT callee, min(ord) AS ord FROM c GROUP BY callee ORDER BY callee LIMIT 20""")
def callees(t):
    return graph.callees(t["nodes"], t["edges"], "customer_4")


@query(f"""SELECT id, name, token_count FROM nodes WHERE id IN (SELECT source FROM edges WHERE relation IN {CALLED} AND target = (SELECT min(id) FROM nodes WHERE name = 'm2')) ORDER BY token_count, name, id LIMIT 15""")
def callers_summary(t):
    target = t["nodes"].where("name = 'm2'").agg(F.min("id")).first()[0]
    return graph.callers_summary(t["nodes"], t["edges"], target)


@query("""WITH x AS (SELECT id, name, CASE WHEN name = 'customer_12' OR ends_with(regexp_replace(split_part(id, '::', 1), '^FILE:', ''), '/customer_12') THEN 1 WHEN lower(name) = 'customer_12' THEN 2 WHEN starts_with(lower(name), 'customer_12') OR contains(lower(id), '::customer_12') OR ends_with(lower(id), 'customer_12') THEN 3 END AS tier FROM nodes)
SELECT id, name, tier FROM x WHERE tier IS NOT NULL""")
def name_tiers(t):
    return t["nodes"].withColumn("tier", graph.name_tier("customer_12")).where("tier IS NOT NULL").select("id", "name", "tier")


@query("SELECT id, name, 2 AS tier FROM nodes WHERE lower(name) = 'part_77'")
def name_variant_lookup(t):
    return graph.lookup(t["nodes"], "part_77").select("id", "name", "tier")


@query("""WITH x AS (SELECT id, name, type, CASE WHEN name = 'm4' THEN 100 WHEN lower(name) = 'm4' THEN 80 WHEN contains(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), 'm4') OR contains('m4', lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))) THEN 40 ELSE 0 END
 + CASE WHEN type = 'Method' AND string_split(id, '::')[-2] = 'Nation5' THEN 50 ELSE 0 END + CASE WHEN contains(id, 'Nation5::m4') THEN 30 ELSE 0 END AS score FROM nodes WHERE type <> 'File')
SELECT id, name, type, score FROM x WHERE score > 0 ORDER BY score DESC, name, id LIMIT 5""")
def similar_nodes(t):
    return graph.similar_nodes(t["nodes"], "Nation5::m4")


@query("""SELECT type, count(*) AS n, array_to_string(list_sort(list(DISTINCT name))[1:15], ',') AS shown FROM nodes WHERE starts_with(id, 'FILE:core/src/r0.rs::') GROUP BY type""")
def structure(t):
    return graph.structure(t["nodes"], t["edges"], "FILE:core/src/r0.rs")


@query("SELECT trait_impl, id, count(*) OVER (PARTITION BY trait_impl) AS n FROM nodes WHERE type IN ('Method', 'Function') AND name = 'm1' AND trait_impl IS NOT NULL")
def impls(t):
    return graph.impls(t["nodes"], "m1")


UP = """WITH up AS (SELECT DISTINCT source AS child, target AS parent FROM edges WHERE relation = 'INHERITS'),
a AS (SELECT child AS id, parent AS ancestor, 1 AS steps FROM up UNION ALL SELECT a.id, up.parent, a.steps + 1 FROM a JOIN up ON a.ancestor = up.child WHERE a.steps < 5),
best AS (SELECT id, ancestor, min(steps) AS steps FROM a GROUP BY id, ancestor)"""


@query(UP + " SELECT id, ancestor, steps FROM best")
def ancestors(t):
    return graph.ancestors(t["edges"])


@query(UP + """, chain AS (SELECT id, id AS ancestor, 0 AS steps FROM nodes WHERE type = 'Class' UNION ALL SELECT * FROM best),
owned AS (SELECT DISTINCT e.source AS ancestor, e.target AS method, n.name, n.ord FROM edges e JOIN nodes n ON n.id = e.target WHERE e.relation = 'DEFINES' AND n.type = 'Method')
SELECT id, name, method, steps FROM (SELECT chain.id, owned.name, owned.method, chain.steps, row_number() OVER (PARTITION BY chain.id, owned.name ORDER BY chain.steps, owned.ord) AS k FROM chain JOIN owned USING (ancestor)) WHERE k = 1""")
def flatten(t):
    return graph.flatten(t["nodes"], t["edges"])


def _walk(start: str, relations: str) -> str:
    return f"""WITH st AS (SELECT source, target, min(ord) AS ord FROM edges WHERE relation IN {relations} GROUP BY 1, 2),
l0 AS (SELECT id, [id] AS path, []::BIGINT[] AS ords, 0 AS steps FROM nodes WHERE id = (SELECT min(id) FROM nodes WHERE name = '{start}')),
n1 AS (SELECT target AS id, list_append(path, target) AS path, list_append(ords, ord) AS ords, 1 AS steps FROM l0 JOIN st ON l0.id = st.source WHERE NOT list_contains(path, target)),
l1 AS (SELECT id, path, ords, steps FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ords, path) AS k FROM n1) WHERE k = 1 AND id NOT IN (SELECT id FROM l0)),
n2 AS (SELECT target AS id, list_append(path, target) AS path, list_append(ords, ord) AS ords, 2 AS steps FROM l1 JOIN st ON l1.id = st.source WHERE NOT list_contains(path, target)),
l2 AS (SELECT id, path, ords, steps FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ords, path) AS k FROM n2) WHERE k = 1 AND id NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1)),
n3 AS (SELECT target AS id, list_append(path, target) AS path, list_append(ords, ord) AS ords, 3 AS steps FROM l2 JOIN st ON l2.id = st.source WHERE NOT list_contains(path, target)),
l3 AS (SELECT id, path, ords, steps FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ords, path) AS k FROM n3) WHERE k = 1 AND id NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1 UNION ALL SELECT id FROM l2))
SELECT id, steps, array_to_string(path, '>') AS path FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _start(t, name: str) -> DataFrame:
    return t["nodes"].where(F.col("name") == name).agg(F.min("id").alias("id")).where("id IS NOT NULL")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "steps", F.array_join("path", ">").alias("path"))


@query(_walk("customer_4", "('CALLS_RESOLVED')"))
def bfs_path(t):
    return _shown(graph.reachable(t["edges"], _start(t, "customer_4"), ["CALLS_RESOLVED"]))


SHORT = "CASE WHEN starts_with(target, 'REF:') THEN 'REF:' || CASE WHEN target LIKE '%::%' THEN substr(target, 5) WHEN target LIKE '%.%' THEN regexp_extract(target, '([a-z_0-9]+)$', 1) ELSE substr(target, 5) END ELSE target END"
FORWARD = f"SELECT source AS id, list(target ORDER BY ord, target)[1:10] AS kids FROM (SELECT source, {SHORT} AS key, arg_min(target, ord) AS target, min(ord) AS ord FROM edges WHERE relation IN ('CALLS', 'CALLS_RESOLVED') GROUP BY 1, 2) GROUP BY source"
BACKWARD = f"""SELECT id, list(source ORDER BY source)[1:10] AS kids FROM (SELECT n.id, e.source FROM nodes n JOIN edges e ON regexp_extract(e.target, '([A-Za-z_0-9]+)$', 1) = n.name WHERE e.relation IN {CALLED}
 UNION SELECT n.id, e.source FROM nodes n JOIN nodes m ON m.name = n.name JOIN edges e ON e.target = m.id WHERE e.relation IN {CALLED}) GROUP BY id"""


def _visit(start: str, kids: str) -> str:
    """A depth-first visit with a stack, one node at a time."""
    return f"""WITH kids AS ({kids}), known AS (SELECT id, name FROM nodes),
dfs AS (SELECT 0 AS k, [(SELECT min(id) FROM nodes WHERE name = '{start}')] AS stack, [1] AS depths, []::VARCHAR[] AS seen, []::VARCHAR[] AS shown, []::INT[] AS lvl
 UNION ALL SELECT k + 1, CASE WHEN go AND depths[1] < 3 THEN list_concat(coalesce(kids.kids, []), stack[2:]) ELSE stack[2:] END, CASE WHEN go AND depths[1] < 3 THEN list_concat(list_transform(coalesce(kids.kids, []), lambda x: depths[1] + 1), depths[2:]) ELSE depths[2:] END,
  CASE WHEN new THEN list_append(seen, stack[1]) ELSE seen END, CASE WHEN go THEN list_append(shown, stack[1]) ELSE shown END, CASE WHEN go THEN list_append(lvl, depths[1]) ELSE lvl END
 FROM (SELECT dfs.*, NOT list_contains(seen, stack[1]) AND len(seen) < 100 AS new, NOT list_contains(seen, stack[1]) AND len(seen) < 100 AND known.id IS NOT NULL AS go FROM dfs LEFT JOIN known ON known.id = stack[1] WHERE len(stack) > 0) d LEFT JOIN kids ON kids.id = d.stack[1]),
last AS (SELECT shown, lvl FROM dfs WHERE len(stack) = 0)
SELECT i - 1 AS ord, shown[i] AS id, lvl[i] AS steps FROM last, range(1, len(shown) + 1) r(i)"""


@query(_visit("customer_1", FORWARD))
def flow_forward(t):
    return flow.tree(t["nodes"], t["edges"], _start(t, "customer_1")).select("ord", "id", "steps")


@query(_visit("m1", BACKWARD))
def flow_backward(t):
    return flow.tree(t["nodes"], t["edges"], _start(t, "m1"), "backward").select("ord", "id", "steps")


@query(f"""WITH kids AS ({FORWARD}), known AS (SELECT id, name, token_count FROM nodes), root AS (SELECT min(id) AS id FROM nodes WHERE name = 'm2'),
run AS (SELECT 0 AS k, (SELECT kids FROM kids JOIN root USING (id)) AS stack, list_transform((SELECT kids FROM kids JOIN root USING (id)), lambda x: 1) AS depths, [(SELECT id FROM root)] AS seen, []::VARCHAR[] AS shown, []::INT[] AS lvl, []::VARCHAR[] AS modes, 300::BIGINT AS budget
 UNION ALL SELECT k + 1, CASE WHEN further THEN list_concat(coalesce(kids.kids, []), stack[2:]) ELSE stack[2:] END, CASE WHEN further THEN list_concat(list_transform(coalesce(kids.kids, []), lambda x: depths[1] + 1), depths[2:]) ELSE depths[2:] END,
  CASE WHEN mode IS NULL THEN seen ELSE list_append(seen, stack[1]) END, CASE WHEN mode IS NULL THEN shown ELSE list_append(shown, stack[1]) END, CASE WHEN mode IS NULL THEN lvl ELSE list_append(lvl, depths[1]) END, CASE WHEN mode IS NULL THEN modes ELSE list_append(modes, mode) END, CASE WHEN mode = 'inline' THEN budget - token_count ELSE budget END
 FROM (SELECT *, mode = 'inline' AND depths[1] < 3 AND budget - token_count > 0 AND len(seen) + 1 < 100 AS further FROM (SELECT run.*, token_count, CASE WHEN list_contains(seen, stack[1]) THEN NULL WHEN known.id IS NULL THEN 'external' WHEN token_count <= 100 AND token_count <= budget THEN 'inline' ELSE 'summary' END AS mode FROM run LEFT JOIN known ON known.id = stack[1] WHERE len(stack) > 0)) d LEFT JOIN kids ON kids.id = d.stack[1]),
last AS (SELECT shown, lvl, modes FROM run WHERE len(stack) = 0)
SELECT i - 1 AS ord, shown[i] AS id, lvl[i] AS steps, modes[i] AS mode FROM last, range(1, len(shown) + 1) r(i)""")
def callee_expansion(t):
    return flow.expansion(t["nodes"], t["edges"], _start(t, "m2"), 300, 3)


@query(_visit("customer_2", FORWARD).replace("SELECT i - 1 AS ord, shown[i] AS id, lvl[i] AS steps FROM last", ", rows AS (SELECT i AS ord, shown[i] AS id, lvl[i] AS steps FROM last").replace("last AS (", "last AS (") + """)
SELECT r.ord - 1 AS ord, r.id, (SELECT arg_max(p.id, p.ord) FROM rows p WHERE p.ord < r.ord AND p.steps = r.steps - 1) AS parent FROM rows r""")
def flow_tree(t):
    return flow.tree(t["nodes"], t["edges"], _start(t, "customer_2")).select("ord", "id", "parent")


@query(f"""WITH hit AS (SELECT DISTINCT source AS id FROM edges WHERE relation IN {CALLED} AND (target IN (SELECT id FROM nodes WHERE starts_with(lower(name), 'customer_') OR contains(lower(id), '::customer_')) OR (starts_with(target, 'REF:') AND starts_with(regexp_extract(target, '([A-Za-z_0-9]+)$', 1), 'customer_'))))
SELECT id, name, type, token_count FROM hit LEFT JOIN nodes USING (id) ORDER BY id LIMIT 20""")
def callers_fuzzy(t):
    return graph.callers(t["nodes"], t["edges"], "customer_")


@query("""WITH c AS (SELECT source, id, token_count AS t, row_number() OVER (PARTITION BY source ORDER BY o, id) AS k FROM (SELECT source, target AS id, min(ord) AS o FROM edges WHERE relation = 'CALLS_RESOLVED' GROUP BY 1, 2) JOIN (SELECT id, token_count FROM nodes) USING (id)),
f AS (SELECT source, 0::BIGINT AS k, 100 AS budget_left, '' AS taken FROM (SELECT DISTINCT source FROM c)
 UNION ALL SELECT f.source, c.k, CASE WHEN c.t > 0 AND c.t <= f.budget_left THEN f.budget_left - c.t ELSE f.budget_left END, CASE WHEN c.t > 0 AND c.t <= f.budget_left THEN CASE WHEN f.taken = '' THEN c.id ELSE f.taken || ',' || c.id END ELSE f.taken END FROM f JOIN c ON c.source = f.source AND c.k = f.k + 1)
SELECT source, arg_max(budget_left, k) AS budget_left, arg_max(taken, k) AS taken FROM f GROUP BY source""")
def flow_budget(t):
    calls = t["edges"].where("relation = 'CALLS_RESOLVED'").groupBy("source", F.col("target").alias("id")).agg(F.min("ord").alias("ord"))
    return graph.greedy_budget(calls.join(t["nodes"].select("id", "token_count"), "id"), "source", 100)


RESOLVED = """WITH p AS (SELECT id, name, ord, split_part(id, '::', 1) AS file, CASE WHEN len(string_split(id, '::')) > 2 THEN string_split(id, '::')[-2] END AS scope, regexp_replace(id, '::[^:]*$', '') AS pre FROM nodes WHERE type <> 'File'),
r AS (SELECT ord, source, target, regexp_extract(substr(target, 5), '([A-Za-z_0-9]+)$', 1) AS name, CASE WHEN target LIKE '%::%' THEN string_split(substr(target, 5), '::')[-2] END AS rtype, target LIKE 'REF:self.%' AS rself, split_part(source, '::', 1) AS file, regexp_replace(source, '::[^:]*$', '') AS pre FROM edges WHERE starts_with(target, 'REF:') AND target NOT IN ('REF:Vec::new', 'REF:std::mem::swap')),
j AS (SELECT r.ord, r.source, r.target, a.id AS qualified, b.id AS self, c.id AS file, d.id AS name FROM r
 LEFT JOIN (SELECT scope, name, arg_min(id, ord) AS id FROM p WHERE scope IS NOT NULL GROUP BY 1, 2) a ON a.scope = r.rtype AND a.name = r.name
 LEFT JOIN (SELECT pre, name, arg_min(id, ord) AS id FROM p WHERE scope IS NOT NULL GROUP BY 1, 2) b ON r.rself AND b.pre = r.pre AND b.name = r.name
 LEFT JOIN (SELECT file, name, arg_min(id, ord) AS id FROM p GROUP BY 1, 2) c ON r.rtype IS NULL AND c.file = r.file AND c.name = r.name
 LEFT JOIN (SELECT name, arg_min(id, ord) AS id FROM p GROUP BY 1) d ON r.rtype IS NULL AND d.name = r.name),
res AS (SELECT ord, source, target, coalesce(qualified, self, file, name) AS resolved, CASE WHEN qualified IS NOT NULL THEN 'qualified' WHEN self IS NOT NULL THEN 'self' WHEN file IS NOT NULL THEN 'file' WHEN name IS NOT NULL THEN 'name' ELSE 'none' END AS strategy FROM j)"""


@query(RESOLVED + " SELECT * FROM res")
def resolve_refs(t):
    return resolve.resolve(t["nodes"], t["edges"])


@query(RESOLVED + " SELECT strategy, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM res GROUP BY strategy")
def resolution_stats(t):
    return resolve.resolution_stats(resolve.resolve(t["nodes"], t["edges"]))


@query("SELECT target, count(*) AS n FROM edges WHERE target IN ('REF:Vec::new', 'REF:std::mem::swap') GROUP BY target")
def noncall_filter(t):
    return t["edges"].where(F.col("target").startswith("REF:") & resolve.non_project(F.expr("substring(target, 5)"))).groupBy("target").agg(F.count("*").alias("n"))


TOKENS = "regexp_extract_all(lower(%s), '[\\p{L}\\p{Nl}\\p{No}_][\\p{L}\\p{N}_]*')"
IDF = f"""WITH tk AS (SELECT DISTINCT id, ord, unnest({TOKENS % "name || ' ' || docstring"}) AS term FROM docs),
dfs AS (SELECT term, count(*) AS df FROM tk GROUP BY term), nd AS (SELECT count(*) AS n FROM docs),
idfs AS (SELECT term, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM dfs, nd)"""


@query(IDF + " SELECT term, df, round(idf, 6) AS idf FROM idfs")
def idf(t):
    return search.idf(t["docs"]).withColumn("idf", F.round("idf", 6))


def _score_sql(terms: list[str], extra: str = "", where: str = "true") -> str:
    parts, found = [], []
    for k, x in enumerate(terms):
        w = f"coalesce((SELECT idf FROM idfs WHERE term = '{x}'), 1.0)"
        tf = lambda col: f"(len(list_filter({col}, lambda z: z = '{x}')) / greatest(len({col}), 1))"  # noqa: E731, B023
        parts.append(f"{tf('nt')} * {w} * 10 + {tf('dt')} * {w} + CASE WHEN contains(sig, '{x}') THEN {w} * 2 ELSE 0 END + CASE WHEN nm = '{x}' THEN 50 WHEN contains(nm, '{x}') THEN {w} * 5 ELSE 0 END")
        found.append(f"CASE WHEN {tf('nt')} > 0 OR {tf('dt')} > 0 OR contains(sig, '{x}') THEN 1 ELSE 0 END")
    total, n = "s", len(terms)
    if n > 1:
        near = " AND ".join(f"list_contains(ft[i:i + {n + 1}], '{x}')" for x in terms)
        total = f"""CASE WHEN f = {n} THEN 1000 + s * 2 + CASE WHEN contains(nm, '{"_".join(terms)}') OR contains(fl, '{"_".join(terms)}') THEN 500 WHEN contains(fl, '{" ".join(terms)}') THEN 200 ELSE 0 END
          + CASE WHEN len(list_filter(range(1, len(ft) + 1), lambda i: ft[i] = '{terms[0]}' AND {near})) > 0 THEN 100 ELSE 0 END WHEN f > 0 THEN least(s * (f / {n}) * (f / {n}), 999.0) ELSE s END"""
    return f"""{IDF}, x AS (SELECT *, lower(name) AS nm, lower(signature) AS sig, lower(name) || ' ' || lower(docstring) || ' ' || lower(signature) AS fl, {TOKENS % "name"} AS nt, {TOKENS % "docstring"} AS dt, {TOKENS % "name || ' ' || docstring || ' ' || signature"} AS ft FROM docs WHERE {where}),
    y AS (SELECT *, {" + ".join(parts)} AS s, {" + ".join(found)} AS f FROM x), z AS (SELECT *, {total} AS tot FROM y),
    q AS (SELECT id, ord, tot + CASE type WHEN 'Function' THEN 0.5 WHEN 'Method' THEN 0.5 WHEN 'Class' THEN 0.4 WHEN 'Constant' THEN 0.1 WHEN 'File' THEN 0.0 ELSE 0.2 END + CASE WHEN in_degree > 0 THEN ln(1 + in_degree) * 5 ELSE 0 END AS score FROM z WHERE tot > 0)
    SELECT id, ord, round(score, 6) AS score FROM q ORDER BY score DESC, ord LIMIT {extra or 10}"""


@query(_score_sql(["the"]))
def tfidf_single(t):
    return search.search(t["docs"], ["the"]).withColumn("score", F.round("score", 6))


@query(_score_sql(["that", "with", "la"], "25"))
def tfidf_multi(t):
    return search.search(t["docs"], ["that", "with", "la"], limit=25).withColumn("score", F.round("score", 6))


@query(_score_sql(["the", "fn"], "10", "NOT is_test AND crate = 'src2' AND type = 'Class'"))
def search_filtered(t):
    return search.search(t["docs"], ["the", "fn"], crate="src2", lang="cobol", symbol_type="class", exclude_tests=True).withColumn("score", F.round("score", 6))


@query(f"""WITH x AS (SELECT id, {TOKENS % "docstring"} AS ft FROM docs) SELECT id FROM x WHERE len(list_filter(range(1, len(ft) + 1), lambda i: ft[i] = 'of' AND list_contains(ft[i:i + 3], 'the'))) > 0""")
def proximity(t):
    return t["docs"].where(search.proximity(N.tokens(F.col("docstring")), ["of", "the"])).select("id")


@query("""WITH q AS (SELECT vector AS v FROM vecs WHERE vec_id = 0), c AS (SELECT id, type, in_degree, list_cosine_similarity(vector::DOUBLE[], v::DOUBLE[]) AS cosine FROM vecs, q),
n AS (SELECT * FROM c WHERE cosine >= 0.05 ORDER BY cosine DESC, id LIMIT 30)
SELECT id, round(cosine, 6) AS cosine, round(cosine + least(0.15, ln(1 + in_degree) * 0.03) + CASE type WHEN 'Function' THEN 0.02 WHEN 'Class' THEN 0.015 ELSE 0.0 END, 6) AS score FROM n ORDER BY score DESC, id LIMIT 10""")
def cosine_topk(t):
    q = t["vecs"].where("vec_id = 0").first()["vector"]
    return search.nearest(t["vecs"], q, 10, 0.05).select("id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT id, list_transform(vector, lambda x: x::DOUBLE * 0.2 + x::DOUBLE * x::DOUBLE * 0.3 + 0.5 * abs(x::DOUBLE)) AS m FROM vecs)
SELECT id, round(list_sum(list_transform(m, lambda x: x / CASE WHEN list_sum(list_transform(m, lambda y: y * y)) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(m, lambda y: y * y))) END)), 5) AS total FROM m""")
def composite_vec(t):
    sq, ab = F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.transform("vector", lambda x: F.abs(x.cast("double")))
    v = search.composite(F.col("vector"), sq, ab)
    return t["vecs"].select("id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""WITH q AS (SELECT vector AS v FROM vecs WHERE vec_id = 0), a AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(vector::DOUBLE[], v::DOUBLE[]) DESC, id) - 1 AS rank FROM vecs, q),
b AS (SELECT id, row_number() OVER (ORDER BY in_degree DESC, id) - 1 AS rank FROM vecs)
SELECT id, round(coalesce(1 / (60 + a.rank + 1), 0) + coalesce(1 / (60 + b.rank + 1), 0), 6) AS score FROM a FULL JOIN b USING (id)""")
def rrf(t):
    q = F.array(*[F.lit(float(x)) for x in t["vecs"].where("vec_id = 0").first()["vector"]])
    a = search.ranked(t["vecs"].select("id", N.cosine(F.col("vector"), q).alias("cosine")), F.desc("cosine"), "id")
    b = search.ranked(t["vecs"].select("id", "in_degree"), F.desc("in_degree"), "id")
    return search.fuse(a, b).withColumn("score", F.round("score", 6))


HITS = """WITH hit AS (SELECT l.event_id, l.sha, l.file, l.line, l.sign, arg_max(s.id, (s.start - s."end") * 1000000000000 + s.ord) AS id FROM lines l JOIN spans s ON l.file = s.file AND l.line BETWEEN s.start AND s."end" GROUP BY ALL)"""


@query(HITS + " SELECT event_id, file, line, id FROM hit")
def interval_attrib(t):
    return history.attribute(t["lines"].select("event_id", "file", "line"), t["spans"])


@query("""WITH c AS (SELECT l.event_id, l.file, l.line, s.id, abs(l.line - s.start) AS gap, s.start > l.line AS below, s.ord FROM lines l JOIN spans s ON l.file = s.file AND s.start BETWEEN l.line - 9 AND l.line + 9)
SELECT event_id, file, line, id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, below, ord) AS k FROM c) WHERE k = 1""")
def nearest_context(t):
    return history.nearest_span(t["lines"].select("event_id", "file", "line"), t["spans"])


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' OR event_id % 4 = 0 THEN sha END IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM lines")
def forward_fill(t):
    rows = t["lines"].withColumn("v", F.when((F.col("event_type") == "view") | (F.col("event_id") % 4 == 0), F.col("sha")))
    return history.fill_forward(rows, "file", "event_id", "v").select("event_id", "filled")


@query("SELECT event_id, 10 + coalesce(sum(CASE WHEN sign <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line FROM lines")
def line_counter(t):
    return history.new_lines(t["lines"].drop("line").withColumn("start", F.lit(10)), "file", "event_id", "start", "sign").select("event_id", "line")


@query("SELECT file, count(DISTINCT sha) AS commits FROM lines GROUP BY file ORDER BY commits DESC, file LIMIT 20")
def churn_files(t):
    return history.file_churn(t["lines"])


@query(HITS + " SELECT id, count(DISTINCT sha) AS commits, count(*) FILTER (sign = '+') AS added, count(*) FILTER (sign = '-') AS removed FROM hit GROUP BY id")
def churn_symbols(t):
    return history.symbol_churn(t["lines"], t["spans"])


@query(HITS + " SELECT id, count(DISTINCT sha) AS commits, count(*) FILTER (sign = '+') AS added, count(*) FILTER (sign = '-') AS removed, count(*) AS changed FROM hit GROUP BY id ORDER BY changed DESC, id LIMIT 50")
def change_impact(t):
    return history.impact(t["lines"], t["spans"])


@query("""WITH own AS (SELECT DISTINCT user_id % 500 AS sha, event_type || '/' || CAST(event_id % 50 AS STRING) AS item FROM events), ok AS (SELECT sha FROM own GROUP BY sha HAVING count(*) >= 2)
SELECT x.item AS a, y.item AS b, count(*) AS together FROM own x JOIN own y ON x.sha = y.sha AND x.item < y.item WHERE x.sha IN (SELECT sha FROM ok) GROUP BY 1, 2 HAVING count(*) >= 2""")
def cochange(t):
    return history.co_change(t["events"].select((F.col("user_id") % 500).alias("sha"), F.concat_ws("/", "event_type", (F.col("event_id") % 50).cast("string")).alias("item")), "item")


@query("SELECT file, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors, min(day) AS since, max(day) AS until FROM lines GROUP BY file")
def evolution(t):
    return history.evolution(t["lines"], "file")


@query("SELECT CAST(page_id AS STRING) AS path, md5(html) AS sha FROM pages WHERE page_id % 3 = 0")
def manifest_changed(t):
    files = t["pages"].select(F.col("page_id").cast("string").alias("path"), F.md5(F.col("html").cast("binary")).alias("sha"))
    return history.changed(files, files.where("CAST(path AS BIGINT) % 3 <> 0"))


@query("""WITH s AS (SELECT id, method, path, 0 AS try FROM requests UNION ALL SELECT id, method, np, 1 FROM (SELECT *, CASE WHEN starts_with(path, '/api/v1') THEN substr(path, 8) WHEN starts_with(path, '/api/v2') THEN substr(path, 8) WHEN starts_with(path, '/api') THEN substr(path, 5) ELSE path END AS np FROM requests) WHERE np <> path),
h AS (SELECT s.id, s.try, s.path <> e.path AS loose, e.ord, e.path AS template, e.operation FROM s JOIN endpoints e ON s.method = e.method AND regexp_full_match(s.path, regexp_replace(replace(e.path, '.', '\\.'), '\\{[^}]*\\}', '[^/]+', 'g')))
SELECT r.id, k.template, k.operation FROM requests r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY try, loose, ord) AS k FROM h) WHERE k = 1) k USING (id)""")
def endpoint_match(t):
    return crosslang.match(t["requests"], t["endpoints"])


LINK = "WITH last AS (SELECT name AS operation, arg_max(id, ord) AS handler FROM nodes WHERE type IN ('Function', 'Method') GROUP BY name)"


@query(LINK + " SELECT e.ord, e.operation, handler FROM endpoints e LEFT JOIN last USING (operation)")
def handler_link(t):
    return crosslang.handlers(t["endpoints"], t["nodes"]).select("ord", "operation", "handler")


@query("SELECT path, method, operation FROM endpoints WHERE lower(tag) = 'users'")
def endpoint_list(t):
    return crosslang.listed(t["endpoints"].withColumn("tags", F.array("tag")), "USERS").select("path", "method", "operation")


@query(LINK + " SELECT count(*) AS endpoints, count(DISTINCT CASE WHEN handler IS NOT NULL THEN operation END) AS linked FROM endpoints LEFT JOIN last USING (operation)")
def endpoint_stats(t):
    return crosslang.stats(crosslang.handlers(t["endpoints"], t["nodes"]))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace('getHTTP' || p_brand || 'ById', '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')) AS name FROM part")
def normalize_name(t):
    return t["part"].select("p_partkey", N.normalize_name(F.concat(F.lit("getHTTP"), "p_brand", F.lit("ById"))).alias("name"))


@query("""WITH x AS (SELECT id, name AS n, lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')) AS s FROM nodes)
SELECT id, array_to_string(list_sort(list_distinct(list_filter([n, CASE WHEN s <> lower(n) THEN s END, lower(n)], lambda z: z IS NOT NULL))), '|') AS variants FROM x""")
def name_variants(t):
    return t["nodes"].select("id", F.array_join(N.name_variants(F.col("name")), "|").alias("variants"))


@query("""SELECT ord, CASE WHEN target LIKE '%::%' THEN regexp_extract(substr(target, 5), '^([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+)', 1) WHEN target LIKE '%.%' THEN regexp_extract(target, '([A-Za-z_0-9]+)$', 1) ELSE substr(target, 5) END AS name FROM edges WHERE starts_with(target, 'REF:')""")
def clean_ref(t):
    return t["edges"].where(F.col("target").startswith("REF:")).select("ord", N.clean_ref(F.expr("substring(target, 5)")).alias("name"))


@query("""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l, n_chars // 4 AS tc FROM documents)
SELECT doc_id, md5(array_to_string(CASE WHEN tc < 1000 OR len(l) <= 100 OR len(l) <= (CASE WHEN tc < 1800 THEN 60 ELSE 50 END) + 20 THEN l ELSE list_concat(list_concat(l[1:CASE WHEN tc < 1800 THEN 60 ELSE 50 END], ['... (' || (len(l) - (CASE WHEN tc < 1800 THEN 60 ELSE 50 END) - 15) || ' more lines)']), l[len(l) - 14:len(l)]) END, chr(10))) AS shown FROM x""")
def head_tail(t):
    shown = N.head_tail(F.split("text", "\n"), F.floor(F.col("n_chars") / 4))
    return t["documents"].select("doc_id", F.md5(F.array_join(shown, "\n").cast("binary")).alias("shown"))


@query("SELECT conv_id, turn, len(text) // 4 AS tokens FROM conversations")
def estimate_tokens(t):
    return t["conversations"].select("conv_id", "turn", N.estimate_tokens(F.col("text")).alias("tokens"))


@query("""WITH x AS (SELECT ord, source, target, CASE WHEN lower(source) LIKE '%example%' THEN 0 WHEN lower(source) LIKE '%test%' THEN 1 ELSE 2 END AS rank FROM edges WHERE relation IN ('CALLS', 'CALLS_RESOLVED') AND (regexp_replace(target, '^REF:', '') = 'm5' OR ends_with(target, '.m5') OR ends_with(target, '::m5')))
SELECT * FROM x ORDER BY rank, ord LIMIT 3""")
def usage_examples(t):
    return graph.usage_examples(t["edges"], "m5")


@query("SELECT id, name, type FROM nodes WHERE name = 'test_customer_7' AND type IN ('Function', 'Method')")
def related_tests(t):
    return graph.related_tests(t["nodes"], "customer_7")


@query("""SELECT regexp_replace(id, '::[^:]*$', '') AS class_id, count(*) AS n, string_agg(name, ',' ORDER BY lineno, ord, name) AS methods FROM nodes WHERE type = 'Method' AND regexp_replace(id, '::[^:]*$', '') IN (SELECT id FROM nodes WHERE type = 'Class') GROUP BY 1""")
def class_children(t):
    return graph.class_children(t["nodes"])


@query("SELECT name, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, ord) AS k FROM (SELECT *, CASE WHEN type IN ('Function', 'Method') THEN 0 WHEN type = 'Class' THEN 1 ELSE 2 END AS rank FROM nodes)) WHERE k = 1")
def type_priority(t):
    return graph.prioritised(t["nodes"])


@query("""WITH p AS (SELECT id, regexp_replace(split_part(id, '::', 1), '^FILE:', '') AS path, type, name FROM nodes)
SELECT id, contains(path, '/tests/') OR ends_with(path, '_test.rs') OR (type IN ('Function', 'Method') AND regexp_matches(name, '^(test_|it_|describe_|spec_)')) AS is_test, split_part(path, '/', 1) AS crate, CASE WHEN ends_with(path, '.rs') THEN 'rust' WHEN ends_with(path, '.ts') THEN 'typescript' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.svelte') THEN 'svelte' END AS lang FROM p""")
def derived_filters(t):
    path = N.file_of(F.col("id"))
    return t["nodes"].select("id", N.is_test(path, F.col("type"), F.col("name")).alias("is_test"), N.crate_of(path).alias("crate"), N.lang_of(path).alias("lang"))


@query(f"""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w, lower(text) AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN {" OR ".join(f"contains(l, '{p}')" for p in N.PHRASES)} OR lower(w[1]) IN ({", ".join(f"'{x}'" for x in N.QUESTIONS)}) THEN true WHEN regexp_matches(l, '[a-z]+_[a-z]+') OR contains(l, '::') THEN false ELSE len(w) >= 3 END AS natural_language FROM w""")
def nl_classifier(t):
    return t["conversations"].select("conv_id", "turn", N.is_question(F.split("text", " ")).alias("natural_language"))


@query("""WITH c AS (SELECT target, count(*) AS n FROM edges GROUP BY target)
SELECT n.id, n.type, coalesce(c.n, 0) AS in_degree FROM nodes n LEFT JOIN c ON c.target = n.id WHERE n.name <> '' AND NOT starts_with(n.name, '_') AND NOT contains(lower(n.id), 'test') AND n.type IN ('Function', 'Method', 'Class') ORDER BY in_degree DESC, n.id LIMIT 5""")
def examples(t):
    return graph.examples(t["nodes"], t["edges"])


@query("""SELECT k.doc_id AS diff, k.k, 'src/f' || (k.doc_id % 7) || '.rs' AS file, 5 + k.k - 3 - (CASE WHEN k.k > 4 THEN 1 ELSE 0 END) AS line, CASE k.k WHEN 3 THEN ' ' WHEN 4 THEN '-' WHEN 5 THEN '+' ELSE ' ' END AS sign FROM (SELECT doc_id, unnest([3, 4, 5, 6]) AS k FROM documents) k""")
def diff_hunks(t):
    path = F.concat(F.lit("src/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".rs"))
    text = F.array(F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), F.lit("@@ -5,3 +5,3 @@ fn"), F.lit(" same"), F.lit("-old"), F.lit("+new"), F.lit(" end"))
    lines = t["documents"].select(F.col("doc_id").alias("diff"), F.posexplode(text).alias("k", "text"))
    return history.parse_diff(lines).select("diff", "k", "file", "line", "sign")


@query("SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges FROM nodes")
def graph_counts(t):
    return t["nodes"].agg(F.count("*").alias("nodes")).join(t["edges"].agg(F.count("*").alias("edges")))  # one row each


def streaming_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, an extension: the events replayed as a stream of changes."""
    return churn.replay(spark, sf_dir, "events.parquet").select(F.date_format("since", "yyyy-MM-dd").alias("since"), "event_type", "changes")


QUERIES["streaming_churn"] = streaming_churn
ORACLES["streaming_churn"] = "SELECT strftime(ts, '%Y-%m-%d') AS since, event_type, count(*) AS changes FROM events GROUP BY ALL"
