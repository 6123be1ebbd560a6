"""Further queries over the test tables: extractors, symbol indexes, version control, reports, sources and sinks, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import sinks
from loomgraph.functions import extract
from loomgraph.functions import names as N
from loomgraph.operators import crosslang, graph, history, resolve, search, sections, symbols
from loomgraph.plans.queries import CALLED, HITS, query
from loomgraph.plans.sources import SOURCES
from loomgraph.sources import projects, readers, versions


def _files(t, ext: str, text: str) -> DataFrame:
    """A file for each supplier, with its number in the names."""
    key = F.col("s_suppkey").cast("string")
    return t["supplier"].select(F.concat(F.lit("n"), key, F.lit(f".{ext}")).alias("path"), F.replace(F.lit(text), F.lit("@@"), key).alias("content"))


def _values(rows: str, width: int) -> str:
    """VALUES of lines of words; a missing last word is null."""
    split = [(x.split(" ") + ["null"])[:width] for x in rows.strip("\n").split("\n") if x]
    shown = lambda w, k: w if k >= 2 and (w.isdigit() or w == "null") else "'" + w.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(shown(w, k) for k, w in enumerate(r)) + ")" for r in split)


def _extracted(name: str, ext: str, text: str, nodes: str, edges: str) -> None:
    file = f"'FILE:n' || CAST(s_suppkey AS STRING) || '.{ext}'"
    own = lambda c: f"replace({c}, '@@', CAST(s_suppkey AS STRING))"

    def symbols_of(t):
        return extract.extract(_files(t, ext, text)).where("kind = 'node'").select("id", "type", "lineno", "end_lineno")

    symbols_of.__name__ = f"extract_{name}"
    query(f"SELECT {file} || CASE WHEN v.n = '' THEN '' ELSE '::' || {own('v.n')} END AS id, v.type, v.lineno, v.end_lineno FROM supplier, (VALUES {_values(nodes, 4)}) v(type, n, lineno, end_lineno)")(symbols_of)

    def edges_of(t):
        return extract.extract(_files(t, ext, text)).where("kind = 'edge'").select("source", "target", "relation", "lineno")

    edges_of.__name__ = f"edges_{name}"
    if edges.strip():
        rows = "\n".join(" ".join([x.split(" ")[0], x.split(" ")[2], *([x.split(" ")[1]]), *x.split(" ")[3:]]) for x in edges.strip("\n").split("\n"))
        values = ", ".join("(" + ", ".join(w if w.isdigit() or w == "null" else "'" + w + "'" for w in (r.split(" ") + ["null"])[:4]) + ")" for r in rows.split("\n"))
        at = lambda c: f"CASE WHEN {c} = '.' THEN {file} WHEN starts_with({c}, 'REF:') OR starts_with({c}, 'MODULE:') THEN {own(c)} ELSE {file} || '::' || {own(c)} END"
        query(f"SELECT {at('v.s')} AS source, {at('v.t')} AS target, v.relation, v.lineno FROM supplier, (VALUES {values}) v(s, t, relation, lineno)")(edges_of)


for _name, _parts in SOURCES.items():
    _extracted(_name, *_parts)


# Symbols of five schemes, by the number of a part.
SYMBOL = """CASE p_partkey % 6 WHEN 0 THEN 'rust-analyzer cargo c' || CAST(p_size AS STRING) || ' 0.1.0 state/App' || CAST(p_size AS STRING) || '#new().'
 WHEN 1 THEN 'rust-analyzer cargo mydb 0.1.0 impl#[S' || CAST(p_size AS STRING) || ']go().' WHEN 2 THEN 'scip-typescript npm web 1.0 src/lib/`client.ts`/get' || CAST(p_size AS STRING) || '().'
 WHEN 3 THEN 'scip-python python . 1.0 src/`a.py`/Store' || CAST(p_size AS STRING) || '#function#$fetch().' WHEN 4 THEN 'semanticdb maven maven/org.x/clients 3.6 org/x/Id' || CAST(p_size AS STRING) || '#Inner#random().' ELSE 'local ' || CAST(p_size AS STRING) END"""
SYMBOL_FILE = "CASE p_partkey % 6 WHEN 2 THEN 'web/src/f.ts' ELSE 'src/f' || CAST(p_partkey % 9 AS STRING) || '.rs' END"


def _symbols(t) -> DataFrame:
    return t["part"].selectExpr("p_partkey", f"{SYMBOL} AS symbol", f"{SYMBOL_FILE} AS file")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'App' || p_size || '|new' WHEN 1 THEN 'S' || p_size || '|go' WHEN 2 THEN 'get' || p_size WHEN 3 THEN 'Store' || p_size || '|$fetch' WHEN 4 THEN 'Id' || p_size || '|Inner|random' ELSE '' END AS names FROM part""")
def symbol_names(t):
    return _symbols(t).select("p_partkey", F.array_join(N.symbol_parts(F.col("symbol")), "|").alias("names"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'FILE:c' || p_size || '/src/f' || (p_partkey % 9) || '.rs::App' || p_size || '::new' WHEN 1 THEN 'FILE:mydb/src/f' || (p_partkey % 9) || '.rs::S' || p_size || '::go' WHEN 2 THEN 'FILE:web/src/f.ts::get' || p_size
 WHEN 3 THEN 'FILE:src/f' || (p_partkey % 9) || '.rs::Store' || p_size || '::$fetch' WHEN 4 THEN 'FILE:src/f' || (p_partkey % 9) || '.rs::Id' || p_size || '::Inner::random' ELSE 'FILE:src/f' || (p_partkey % 9) || '.rs' END AS node FROM part""")
def symbol_nodes(t):
    return _symbols(t).select("p_partkey", N.symbol_node(F.col("symbol"), F.col("file")).alias("node"))


# An index over the test tables: parts define symbols, lines of orders refer to them.
OCCURRENCES = """SELECT p_partkey AS place, 'pkg/f' || CAST(p_partkey % 40 AS STRING) || '.rs' AS file, 'rust-analyzer cargo pkg 1.0 m/T' || CAST(p_size AS STRING) || '#fn' || CAST(p_partkey % 300 AS STRING) || '().' AS symbol, CAST(p_size AS INT) AS line, true AS is_definition FROM part
 UNION ALL SELECT 1000000000 + l_orderkey * 10 + l_linenumber, 'src/o' || CAST(l_orderkey % 500 AS STRING) || '.rs', 'rust-analyzer cargo pkg 1.0 m/T' || CAST(p_size AS STRING) || '#fn' || CAST(p_partkey % 300 AS STRING) || '().', CAST(l_orderkey % 97 AS INT), false FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2"""
INDEX_REFS = """SELECT o_orderkey AS ord, 'top/src/o' || CAST(o_orderkey % 500 AS STRING) || '.rs' AS file, CAST(o_orderkey % 97 + 1 AS INT) AS lineno, CASE o_custkey % 3 WHEN 0 THEN 'T' || CAST(o_custkey % 50 AS STRING) || '::fn' || CAST(o_custkey % 400 AS STRING) ELSE 'fn' || CAST(o_custkey % 400 AS STRING) END AS ref FROM orders"""
INDEX_SQL = f"""WITH occ AS ({OCCURRENCES}), refs AS ({INDEX_REFS}),
def AS (SELECT symbol, arg_min(file, place) AS file, min(place) AS place, regexp_extract(symbol, '#(\\w+)', 1) AS name, regexp_extract(symbol, 'm/(\\w+)#', 1) AS owner FROM occ WHERE is_definition GROUP BY symbol),
node AS (SELECT *, 'FILE:' || file || '::' || owner || '::' || name AS node FROM def),
loc AS (SELECT r.ord, arg_min(n.node, n.place) AS candidate FROM refs r JOIN occ o ON o.file = substr(r.file, 5) AND o.line = r.lineno - 1 JOIN node n ON n.symbol = o.symbol AND n.name = regexp_extract(r.ref, '(\\w+)$', 1) GROUP BY r.ord),
nam AS (SELECT r.ord, coalesce(arg_min(n.node, n.place) FILTER (contains(r.ref, '::') AND contains(lower(n.symbol), lower(split_part(r.ref, '::', 1)))), arg_min(n.node, n.place)) AS candidate FROM refs r JOIN node n ON n.name = regexp_extract(r.ref, '(\\w+)$', 1) GROUP BY r.ord)"""


def _index(t) -> tuple[DataFrame, DataFrame]:
    spark = t["part"].sparkSession
    return spark.sql(INDEX_REFS), spark.sql(OCCURRENCES)


@query(INDEX_SQL + " SELECT * FROM loc")
def index_by_location(t):
    refs, occurrences = _index(t)
    return symbols.by_location(refs, occurrences, symbols.definitions(occurrences))


@query(INDEX_SQL + " SELECT * FROM nam")
def index_by_name(t):
    refs, occurrences = _index(t)
    return symbols.by_name(refs, symbols.definitions(occurrences))


@query(INDEX_SQL + " SELECT * FROM loc UNION ALL SELECT * FROM nam WHERE ord NOT IN (SELECT ord FROM loc)")
def index_candidates(t):
    return symbols.candidates(*_index(t))


@query("""WITH r AS (SELECT ord, source, target, substr(target, 5) AS ref FROM edges WHERE starts_with(target, 'REF:') AND target NOT IN ('REF:Vec::new', 'REF:std::mem::swap')),
c AS (SELECT r.ord, n.id AS candidate, n.name FROM r JOIN (SELECT * FROM nodes WHERE ord % 2 = 0) n ON n.name = regexp_extract(r.ref, '([A-Za-z_0-9]+)$', 1) QUALIFY row_number() OVER (PARTITION BY r.ord ORDER BY n.ord DESC) = 1)
SELECT r.ord, c.candidate AS resolved FROM r JOIN c USING (ord) WHERE split_part(regexp_replace(c.candidate, '^FILE:', ''), '/', 1) = split_part(regexp_replace(r.source, '^FILE:', ''), '/', 1) OR contains(lower(r.ref), lower(c.name))""")
def resolve_index(t):
    refs = resolve.references(t["edges"]).withColumn("name", resolve.last_part(F.col("ref")))
    last = t["nodes"].where("ord % 2 = 0").groupBy("name").agg(F.max_by("id", "ord").alias("candidate"))
    found = resolve.resolve(t["nodes"], t["edges"], index=refs.join(last, "name").select("ord", "candidate"))
    return found.where("strategy = 'index'").select("ord", "resolved")


@query("""WITH x AS (SELECT ord, CASE WHEN source LIKE '%.rs::%' THEN 'rust' WHEN source LIKE '%.py::%' THEN 'python' ELSE 'typescript' END AS lang, regexp_extract(substr(target, 5), '([A-Za-z_0-9]+)$', 1) AS name, target LIKE '%::%' AS typed, CASE WHEN target LIKE '%::%' THEN string_split(substr(target, 5), '::')[-2] END AS rtype, source, target FROM edges WHERE starts_with(target, 'REF:') AND target NOT IN ('REF:Vec::new', 'REF:std::mem::swap')),
n AS (SELECT DISTINCT name, CASE WHEN len(string_split(id, '::')) > 2 THEN string_split(id, '::')[-2] END AS scope FROM nodes WHERE type <> 'File'),
y AS (SELECT x.*, CASE WHEN typed THEN EXISTS (SELECT 1 FROM n WHERE n.name = x.name AND n.scope = x.rtype) ELSE EXISTS (SELECT 1 FROM n WHERE n.name = x.name) END AS hit FROM x)
SELECT lang, count(*) AS attempted, count(*) FILTER (hit) AS resolved, round(100 * count(*) FILTER (hit) / count(*), 1) AS percent FROM y GROUP BY lang""")
def resolution_by_language(t):
    return resolve.resolution_stats(resolve.resolve(t["nodes"], t["edges"]), N.family_of(N.file_of(F.col("source"))))


# The lines of each document as a log: a line of hash, day and author, then the text's lines.
LOG = "SELECT doc_id AS log, CAST(sha1(CAST(doc_id AS {s})) AS {s}) || ' 2024-01-' || lpad(CAST(doc_id % 28 + 1 AS {s}), 2, '0') || ' An Author ' || CAST(doc_id % 7 AS {s}) AS head, text FROM documents"


@query(f"""WITH l AS ({LOG.format(s="VARCHAR")}), x AS (SELECT log, list_prepend('', string_split(replace(text, chr(10), ' ' || chr(10) || CASE log % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '+++' END), chr(10))) AS t, head FROM l),
y AS (SELECT log, head, t, list_position(list_transform(t, lambda z: regexp_matches(z, '[^\\s\\x0B\\x0C]')), true) AS s FROM x)
SELECT log, split_part(head, ' ', 1) AS sha, split_part(head, ' ', 2) AS day, regexp_extract(head, '(An Author .*)$', 1) AS author, coalesce(regexp_replace(t[s], '^\\s+|\\s+$', '', 'g'), '') AS subject,
 CASE WHEN log % 3 = 0 AND s > 0 THEN len(list_filter(t[s + 1:], lambda z: starts_with(z, '+') AND NOT starts_with(z, '+++'))) ELSE 0 END AS added, CASE WHEN log % 3 = 1 AND s > 0 THEN len(list_filter(t[s + 1:], lambda z: starts_with(z, '-') AND NOT starts_with(z, '---'))) ELSE 0 END AS removed FROM y WHERE text_ok""".replace(" WHERE text_ok", ""))
def commit_log(t):
    rows = t["documents"].sparkSession.sql(LOG.format(s="STRING"))
    mark = F.when(F.col("log") % 3 == 0, "+").when(F.col("log") % 3 == 1, "-").otherwise("+++")
    body = F.split(F.replace("text", F.lit("\n"), F.concat(F.lit(" \n"), mark)), "\n")
    lines = rows.select("log", F.posexplode(F.concat(F.array("head", F.lit("")), body)).alias("k", "text"))
    return versions.commits(lines).drop("place")


@query("SELECT file, count(DISTINCT sha) AS commits FROM lines WHERE CAST(day AS DATE) >= (SELECT CAST(max(day) AS DATE) - 30 FROM lines) AND (file LIKE 'f1%') GROUP BY file")
def churn_in_range(t):
    today = t["lines"].agg(F.max("day")).first()[0]
    some = history.in_paths(history.in_range(t["lines"], "last 30 days", today), "f1*")
    return history.file_churn(some, None)


@query("SELECT file, count(DISTINCT sha) AS commits FROM lines WHERE file NOT IN ('f1', 'f22') AND NOT starts_with(file, 'f3/') GROUP BY file")
def churn_excluded(t):
    return history.file_churn(history.in_paths(t["lines"], excluded=["f1", "f22", "f3/"]), None)


@query("""SELECT 'FILE:' || file || '.rs' AS id, count(DISTINCT sha) AS commits, count(*) FILTER (sign = '+') AS added, count(*) FILTER (sign = '-') AS removed FROM lines WHERE file IN (SELECT file FROM (SELECT file, count(DISTINCT sha) AS c FROM lines GROUP BY file ORDER BY c DESC, file || CASE WHEN CAST(substr(file, 2) AS INT) % 2 = 0 THEN '.rs' ELSE '.lock' END LIMIT 50)) AND CAST(substr(file, 2) AS INT) % 2 = 0 GROUP BY file""")
def churn_fallback(t):
    """No span holds a line, so code files count themselves."""
    ext = F.when(F.expr("CAST(substring(file, 2) AS INT) % 2 = 0"), ".rs").otherwise(".lock")
    return history.symbol_churn_or_files(t["lines"].withColumn("file", F.concat("file", ext)), t["spans"])


@query(HITS + " SELECT (SELECT count(DISTINCT file) FROM lines) AS files, (SELECT count(DISTINCT sha) FROM lines) AS commits, count(DISTINCT id) AS symbols FROM hit")
def impact_totals(t):
    return history.impact_totals(t["lines"], t["spans"])


@query("""WITH d AS (SELECT target, count(*) AS n FROM edges GROUP BY target) SELECT row_number() OVER (ORDER BY coalesce(n, 0) DESC, contains(lower(id), 'test'), ord) - 1 AS place, id FROM nodes LEFT JOIN d ON d.target = id WHERE name = 'm3' AND contains(lower(id), 'core')""")
def evolution_pick(t):
    return history.pick(graph.in_degree(t["nodes"].where("name = 'm3'"), t["edges"]), "Core")


@query("SELECT split_part(regexp_replace(id, '^FILE:', ''), '::', 1) AS file, count(*) AS symbols FROM nodes WHERE contains(id, '::') GROUP BY 1")
def symbols_by_file(t):
    return graph.symbols_by_file(t["nodes"])


@query("SELECT name, count(*) AS n FROM nodes WHERE type = 'Method' GROUP BY name HAVING count(*) >= 2")
def shared_names(t):
    return graph.shared_names(t["nodes"])


@query("""WITH f AS (SELECT * FROM nodes WHERE name <> '' AND NOT starts_with(name, '_') AND NOT contains(lower(id), 'test')),
a AS (SELECT 'called' AS kind, f.id AS name, count(*) AS n FROM edges e JOIN f ON f.id = e.target AND f.type = 'Function' GROUP BY f.id), b AS (SELECT 'calling' AS kind, f.id AS name, count(*) AS n FROM edges e JOIN f ON f.id = e.source AND f.type = 'Function' GROUP BY f.id HAVING count(*) >= 2),
c AS (SELECT 'files' AS kind, split_part(regexp_replace(id, '^FILE:', ''), '::', 1) AS name, count(*) AS n FROM nodes WHERE contains(id, '::') GROUP BY 2), d AS (SELECT 'methods' AS kind, name, count(*) AS n FROM f WHERE type = 'Method' GROUP BY name HAVING count(*) >= 2),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) - 1 AS place, name, n FROM u QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) <= 3""")
def showcase(t):
    return graph.showcase(t["nodes"], t["edges"])


@query(f"SELECT n.id, coalesce(c.n, 0) AS call_in_degree FROM nodes n LEFT JOIN (SELECT target, count(*) AS n FROM edges WHERE relation IN {CALLED} GROUP BY target) c ON c.target = n.id")
def call_in_degree(t):
    return graph.call_in_degree(t["nodes"], t["edges"]).select("id", "call_in_degree")


# Edges to modules and configurations, beside those of the other tables.
WIRED = """SELECT CAST(p_partkey AS BIGINT) AS ord, 'FILE:web/w' || CAST(p_size AS STRING) || '.ts' AS source, 'MODULE:lib.m' || CAST(p_partkey % 37 AS STRING) AS target, 'IMPORTS' AS relation, CAST(NULL AS INT) AS lineno FROM part
 UNION ALL SELECT 1000000000 + p_partkey, 'FILE:web/w' || CAST(p_size AS STRING) || '.ts', 'FILE:web/w' || CAST(p_size AS STRING) || '.ts::s' || CAST(p_partkey AS STRING), 'DEFINES', NULL FROM part"""
WIRED_NODES = """SELECT CAST(p_partkey AS BIGINT) AS ord, 'FILE:web/w' || CAST(p_size AS STRING) || '.ts::s' || CAST(p_partkey AS STRING) AS id, CASE p_partkey % 4 WHEN 0 THEN 'Configuration' WHEN 1 THEN 'Class' WHEN 2 THEN 'Function' ELSE 'Constant' END AS type, 's' || CAST(p_partkey AS STRING) AS name, CAST(p_partkey * 7 % 1000 AS INT) AS lineno, 'app.use(' || CAST(p_partkey AS STRING) || ')' AS signature FROM part"""


def _wired(t) -> tuple[DataFrame, DataFrame]:
    spark = t["part"].sparkSession
    return spark.sql(WIRED_NODES), spark.sql(WIRED)


@query(f"WITH e AS ({WIRED}) SELECT source AS id, count(DISTINCT target) AS n, array_to_string(list_sort(list(DISTINCT substr(target, 8)))[1:10], ', ') AS shown FROM e WHERE relation = 'IMPORTS' GROUP BY source")
def imports(t):
    return graph.imports(_wired(t)[1])


@query(f"""WITH n AS ({WIRED_NODES}), x AS (SELECT split_part(id, '::', 1) AS file, type, CASE WHEN type = 'Configuration' THEN signature ELSE name END AS txt, CASE WHEN type = 'Configuration' THEN lineno ELSE 0 END AS at_line FROM n)
SELECT file, type, count(*) AS n, array_to_string(list(txt ORDER BY at_line, txt)[1:15], ', ') AS shown FROM x GROUP BY file, type""")
def definitions(t):
    return graph.definitions(*_wired(t))


@query(f"WITH n AS ({WIRED_NODES}) SELECT id, name, signature, lineno FROM n WHERE type = 'Configuration' AND starts_with(id, 'FILE:web/w7.ts::') AND id <> (SELECT min(id) FROM n WHERE type = 'Configuration' AND starts_with(id, 'FILE:web/w7.ts::')) ORDER BY lineno, ord LIMIT 5")
def related_configs(t):
    nodes, edges = _wired(t)
    but = nodes.where("type = 'Configuration' AND startswith(id, 'FILE:web/w7.ts::')").agg(F.min("id")).first()[0]
    return graph.related_configs(nodes, edges, "FILE:web/w7.ts", but)


@query("""SELECT id, name, type FROM (SELECT *, CASE WHEN type = 'File' AND name IN ('test_r2.py', 'r2_test.py', 'r2.test.py', 'r2.spec.py') THEN 0 WHEN type IN ('Function', 'Method') AND (name = 'test_customer_7' OR (starts_with(name, 'test_') AND contains(name, 'customer_7') AND contains(id, 'lib/tests/r2.py'))) THEN 1 END AS kind FROM nodes) WHERE kind IS NOT NULL ORDER BY kind, ord LIMIT 5""")
def related_tests_of_file(t):
    return graph.related_tests(t["nodes"], "customer_7", "lib/tests/r2.py")


@query("SELECT doc_id, md5(array_to_string(CASE WHEN len(l) <= 5 THEN l ELSE list_append(l[1:5], '... (' || (len(l) - 5) || ' more lines)') END, chr(10))) AS shown FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def head_only(t):
    shown = N.head_tail(F.split("text", "\n"), F.col("n_chars"), 5)
    return t["documents"].select("doc_id", F.md5(F.array_join(shown, "\n").cast("binary")).alias("shown"))


# Reports: a document's words dealt into six sections.
SECTIONS = ["source", "callers", "callees", "tests", "examples", "configs"]


def _dealt(words, k: int):
    """Every sixth word; places count from 1."""
    return F.filter(words, lambda x, i: (i + 1) % 6 == k)


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), s AS (SELECT doc_id AS key, k AS ord, ['source', 'callers', 'callees', 'tests', 'examples', 'configs'][k + 1] AS section, list_filter(w, lambda x, i: i % 6 = k) AS l FROM w, range(6) r(k)),
c AS (SELECT *, CASE section WHEN 'examples' THEN 2 WHEN 'tests' THEN 3 WHEN 'configs' THEN 4 WHEN 'callers' THEN 5 WHEN 'callees' THEN 6 ELSE 7 END AS step, CASE section WHEN 'examples' THEN 2 WHEN 'callers' THEN 5 WHEN 'callees' THEN 5 WHEN 'source' THEN 30 ELSE 0 END AS most FROM s),
d AS (SELECT *, CASE WHEN most = 0 THEN []::VARCHAR[] WHEN len(l) > most THEN list_append(l[1:most], '... (' || (len(l) - most) || ' more)') ELSE l END AS short FROM c),
z AS (SELECT *, CASE WHEN len(l) > 0 THEN len(array_to_string(l, chr(10))) + 1 ELSE 0 END AS a, CASE WHEN len(short) > 0 THEN len(array_to_string(short, chr(10))) + 1 ELSE 0 END AS b FROM d),
t AS (SELECT key, k AS steps, sum(CASE WHEN step <= k THEN b ELSE a END) // 4 AS tokens FROM z, range(8) r(k) GROUP BY key, k),
f AS (SELECT key, coalesce(min(steps) FILTER (tokens <= 150), 7) AS steps FROM t GROUP BY key)
SELECT key, ord, section, steps, CASE WHEN step <= steps THEN len(short) ELSE len(l) END AS n, md5(array_to_string(CASE WHEN step <= steps THEN short ELSE l END, chr(10))) AS shown FROM z JOIN f USING (key) WHERE CASE WHEN step <= steps THEN len(short) ELSE len(l) END > 0""")
def truncation_ladder(t):
    words = F.split("text", " ")
    parts = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("section"), _dealt(words, k).alias("lines")) for k, name in enumerate(SECTIONS)])
    rows = t["documents"].select(F.col("doc_id").alias("key"), F.explode(parts).alias("p")).select("key", "p.*")
    out = sections.truncated(rows, 150)
    return out.select("key", "ord", "section", "steps", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("shown"))


FILE_SHAPES = "CASE p_partkey % 12 WHEN 0 THEN 'a/b.RS' WHEN 1 THEN 'x/.env' WHEN 2 THEN 'x/.env.local' WHEN 3 THEN 'k/id_rsa' WHEN 4 THEN 'k/id_rsa.pub' WHEN 5 THEN 'cert.PEM' WHEN 6 THEN 'lib/envy.py' WHEN 7 THEN '.git/config' WHEN 8 THEN 'a/b/.gitignore' WHEN 9 THEN 'app/Main.kt' WHEN 10 THEN 'noext' ELSE 'q/w.cu' END"


@query(f"""WITH x AS (SELECT p_partkey, p_partkey % 12 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'rust' WHEN 6 THEN 'python' WHEN 9 THEN 'kotlin' WHEN 11 THEN 'cuda' ELSE '' END AS syntax, CASE k WHEN 0 THEN 'rust' WHEN 6 THEN 'python' WHEN 9 THEN 'java' WHEN 11 THEN 'clang' ELSE 'unknown' END AS family,
 k IN (0, 6, 9, 11) AS code, k IN (1, 2, 3, 4, 5, 7) AS sensitive FROM x""")
def path_rules(t):
    path = F.col("path")
    rows = t["part"].selectExpr("p_partkey", f"{FILE_SHAPES} AS path")
    return rows.select("p_partkey", N.syntax_lang(path).alias("syntax"), N.family_of(path).alias("family"), N.is_code(path).alias("code"), N.is_sensitive(path).alias("sensitive"))


@query("""SELECT page_id, len(html) < 100 * (page_id % 3) AS odd, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN len(html) >= 99 ELSE false END AS is_text FROM pages WHERE html IS NOT NULL""")
def text_sniff(t):
    html = F.col("html").cast("binary")
    sample = F.when(F.col("page_id") % 3 == 0, html).when(F.col("page_id") % 3 == 1, F.concat(html, F.unhex(F.lit("00")))).otherwise(F.concat(F.unhex(F.lit("FF")), html))
    kept = t["pages"].where("html IS NOT NULL")
    size = F.char_length("html")
    ascii_ = F.octet_length("html") == size
    text = F.when((F.col("page_id") % 3 == 1) & ~ascii_, size >= 99).otherwise(N.is_text(sample))
    return kept.select("page_id", (size < 100 * (F.col("page_id") % 3)).alias("odd"), text.alias("is_text"))


@query("""SELECT id, printf('%d. [%s] %s | %s (%dt, %dc)', ord % 100, type[1:3], name, array_to_string(list_reverse(list_reverse(string_split(split_part(regexp_replace(id, '^FILE:', ''), '::', 1), '/'))[1:2]), '/') || CASE WHEN lineno > 0 THEN ':' || lineno ELSE '' END, token_count, coalesce(n, 0)) AS shown FROM nodes LEFT JOIN (SELECT target, count(*) AS n FROM edges GROUP BY target) ON target = id""")
def compact_lines(t):
    return graph.in_degree(t["nodes"], t["edges"]).select("id", N.compact_line((F.col("ord") % 100).cast("int")).alias("shown"))


@query("""WITH x AS (SELECT *, list_filter(list_transform(string_split(docstring, chr(10)), lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g')), lambda z: z <> '')[1] AS first FROM docs)
SELECT id, '[' || type[1:3] || '] ' || name || ' | ' || split_part(substr(id, 6), '::', 1) || CASE WHEN in_degree > 0 THEN ' (0 toks, ' || in_degree || ' callers)' ELSE '' END || chr(10) || '      ' || signature || coalesce(chr(10) || '      ' || CASE WHEN len(first) > 120 THEN first[1:117] || '...' ELSE first END, '') AS shown FROM x""")
def full_lines(t):
    return t["docs"].withColumns({"lineno": F.lit(None).cast("int"), "token_count": F.lit(0)}).select("id", N.full_lines().alias("shown"))


@query("SELECT id, md5(id) AS key FROM nodes")
def dedup_keys(t):
    return t["nodes"].select("id", N.dedup_key(F.col("id")).alias("key"))


@query("SELECT event_id, round(epoch(TIMESTAMP '2024-07-01 00:00:00' - CAST(ts AS TIMESTAMP)) / 3600, 4) AS age, epoch(TIMESTAMP '2024-07-01 00:00:00' - CAST(ts AS TIMESTAMP)) / 3600 > 24 AS stale FROM events")
def staleness(t):
    now, then = F.lit("2024-07-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    return t["events"].select("event_id", F.round(N.age_hours(now, then), 4).alias("age"), N.is_stale(now, then, 24).alias("stale"))


@query("WITH f AS (SELECT * FROM nodes WHERE type IN ('Function', 'Method') AND (contains(id, 'core/') OR contains(id, 'app/'))), last AS (SELECT name AS operation, arg_max(id, ord) AS handler FROM f GROUP BY name) SELECT e.ord, e.operation, handler FROM endpoints e LEFT JOIN last USING (operation)")
def handlers_within(t):
    return crosslang.handlers(t["endpoints"], t["nodes"], ["core/", "app/"]).select("ord", "operation", "handler")


# Paths of a source tree with projects of several languages.
TREE = "SELECT CASE p_partkey % 10 WHEN 0 THEN 'c' || CAST(p_size AS STRING) || '/Cargo.toml' WHEN 1 THEN 'c' || CAST(p_size AS STRING) || '/src/m.rs' WHEN 2 THEN 'w' || CAST(p_size % 5 AS STRING) || '/package.json' WHEN 3 THEN 'w' || CAST(p_size % 9 AS STRING) || '/a/b.ts' WHEN 4 THEN 'x.sln' WHEN 5 THEN 'deep/er/App.cs' WHEN 6 THEN 'py/z.py' WHEN 7 THEN 'go/sub/go.mod' WHEN 8 THEN 'go/sub/a.go' ELSE 'Gemfile' END AS path FROM part"


@query(f"""WITH p AS (SELECT DISTINCT path FROM ({TREE})), m AS (SELECT DISTINCT CASE WHEN path LIKE '%Cargo.toml' THEN 'rust' WHEN path LIKE '%package.json' THEN 'typescript' WHEN path = 'x.sln' THEN 'dotnet' END AS lang, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS project FROM p WHERE len(string_split(path, '/')) <= 2),
s AS (SELECT DISTINCT CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.cs' THEN 'dotnet' END AS lang, u.project FROM p, unnest(['', split_part(path, '/', 1)]) u(project))
SELECT m.lang, m.project FROM m JOIN s USING (lang, project) UNION ALL SELECT 'python', '' """)
def discover_projects(t):
    return projects.discover(t["part"].sparkSession.sql(TREE).distinct())


@query("SELECT doc_id % 50 AS project, substr(sha256(string_agg(CAST(doc_id AS STRING) || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY CAST(doc_id AS STRING))), 1, 16) AS hash FROM documents GROUP BY 1")
def project_hash(t):
    files = t["documents"].select((F.col("doc_id") % 50).alias("project"), F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return projects.content_hash(files)


@query("SELECT 'rust' AS lang, CAST(p_partkey AS STRING) AS project, p_name AS hash FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 7 = 0")
def projects_to_build(t):
    all_ = t["part"].select(F.lit("rust").alias("lang"), F.col("p_partkey").cast("string").alias("project"), F.col("p_name").alias("hash"))
    known = t["part"].where("p_partkey % 3 <> 0").select(F.lit("rust").alias("lang"), F.col("p_partkey").cast("string").alias("project"), F.when(F.col("p_partkey") % 7 == 0, "old").otherwise(F.col("p_name")).alias("hash"))
    return sinks.to_build(all_, known)


@query("""SELECT CAST(p_partkey AS STRING) AS project, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN p_name ELSE 'kept' END AS hash FROM part""")
def merged_manifest(t):
    key = F.col("p_partkey").cast("string").alias("project")
    old = t["part"].where("p_partkey % 3 <> 0").select(F.lit("rust").alias("lang"), key, F.lit("kept").alias("hash"))
    new = t["part"].where("p_partkey % 3 = 0 OR p_partkey % 7 = 0").select(F.lit("rust").alias("lang"), key, F.col("p_name").alias("hash"))
    return sinks.merged_manifest(old, new).select("project", "hash")


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","none":null}' AS json FROM region""")
def json_rows(t):
    return sinks.as_json(t["region"].select("r_regionkey", "r_name", F.lit(None).cast("string").alias("none")))


@query("SELECT doc_id, count(*) AS lines, CAST(min(k) AS INT) AS first, md5(string_agg(x, chr(10) ORDER BY k)) AS shown FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k, doc_id % 90 + 1 AS at_line, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE k BETWEEN greatest(1, at_line - 50) AND at_line + 50 GROUP BY doc_id")
def source_window(t):
    files = t["documents"].select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    shown = readers.window(files, line=(F.col("doc_id") % 90 + 1).cast("int"))
    return shown.where("size(lines) > 0").select("doc_id", F.size("lines").cast("long").alias("lines"), F.col("start_line").alias("first"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("shown"))


@query("SELECT id, name, CASE WHEN signature <> '' THEN signature END AS signature, md5(substr(docstring, 1, 500)) AS doc FROM docs WHERE name <> ''")
def embedded_texts(t):
    parts = search.embedded_texts()
    return t["docs"].where("name <> ''").select("id", parts["name"].alias("name"), parts["signature"].alias("signature"), F.md5(parts["doc"].cast("binary")).alias("doc"))


@query("SELECT doc_id, regexp_matches(text, '^[a-z]') AS starts_low, 'alias' || (doc_id % 5) || '.x' AS ref, 'mod' || (doc_id % 5) || '.x' AS full_name FROM documents")
def import_scope(t):
    """The first part of a dotted name stands for what the file imported under it."""
    refs = t["documents"].select("doc_id", F.col("text").rlike("^[a-z]").alias("starts_low"), F.col("lang").alias("file"), F.concat(F.lit("alias"), (F.col("doc_id") % 5).cast("string"), F.lit(".x")).alias("ref"))
    imported = t["documents"].select(F.col("lang").alias("file"), F.concat(F.lit("alias"), (F.col("doc_id") % 5).cast("string")).alias("alias"), F.concat(F.lit("mod"), (F.col("doc_id") % 5).cast("string")).alias("module")).distinct()
    return graph.with_imports(refs, imported).select("doc_id", "starts_low", "ref", "full_name")


@query("SELECT 'f' || CAST(p_partkey % 20 AS STRING) AS file, p_size AS lineno, 'call' || (p_partkey % 11) AS callee FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL")
def matcher_calls(t):
    """Calls that an outside matcher reports as JSON, once a line and name; names imported as types only are no calls."""
    row = F.struct(F.concat(F.lit("f"), (F.col("p_partkey") % 20).cast("string")).alias("file"), F.struct(F.struct((F.col("p_size") - 1).alias("line")).alias("start")).alias("range"), F.struct(F.struct(F.struct(F.concat(F.when(F.col("p_partkey") % 5 == 0, "Type").otherwise("call"), (F.col("p_partkey") % 11).cast("string")).alias("text")).alias("NAME")).alias("single")).alias("metaVariables"))
    lines = t["part"].select(F.to_json(row).alias("text"))
    types = t["part"].sparkSession.range(11).select(F.concat(F.lit("Type"), F.col("id").cast("string")).alias("name")).crossJoin(t["part"].sparkSession.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file")))  # 11 x 20 rows
    return readers.matched_calls(lines, types)


@query("SELECT row_number() OVER (ORDER BY ord) - 1 AS place, id FROM nodes WHERE name = 'm2' AND type IN ('Function', 'Method') ORDER BY ord LIMIT 6")
def alternatives(t):
    from loomgraph.engine import Engine

    return Engine(t["nodes"], t["edges"]).alternatives("m2").select("place", "id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'name' ELSE 'sig' END AS used FROM part")
def composite_fallback(t):
    """C11: without a signature or doc the name's vector stands for it."""
    v = lambda x: F.array(F.lit(float(x)), F.lit(0.0))
    name, sig = v(1), F.when(F.col("p_partkey") % 2 == 1, F.array(F.lit(0.0), F.lit(1.0)))
    got = search.composite(name, sig, F.lit(None).cast("array<double>"))
    return t["part"].select("p_partkey", F.when(got[1] > 0, "sig").otherwise("name").alias("used"))


@query("SELECT id, is_test FROM (SELECT id, contains(split_part(id, '::', 1), 'core/') OR (type IN ('Function', 'Method') AND starts_with(name, 'customer_1')) AS is_test FROM nodes)")
def configured_tests(t):
    """UD2: the rules of what is a test come from the configuration."""
    path = N.file_of(F.col("id"))
    return t["nodes"].select("id", N.is_test(path, F.col("type"), F.col("name"), ["core/"], [], "^customer_1").alias("is_test"))

