"""Graph operators over nodes (ord, id, type, name, ...) and edges (ord, source, target, relation, lineno).

ord is the order in which rows were made; "first" always means the least ord. Nothing is collected; tables meet in equi-joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.storage import cut, numbered

CALLS = ["CALLS", "CALLS_RESOLVED", "INSTANTIATES", "INSTANTIATES_RESOLVED"]


def first_of(df: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or ["ord"])))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: edges of every relation that end at each node, with a pre-aggregated join."""
    counts = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.join(counts, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))


def name_tier(query: str, fuzzy: bool = True) -> Column:
    """1 for the name itself (or a path suffix, or an id part), 2 for a naming variant, 3 for a fuzzy hit, null for none."""
    name, node, low = F.col("name"), F.col("id"), query.lower()
    exact = (name == query) | N.file_of(node).endswith("/" + query)
    if "::" in query:
        exact = exact | node.endswith("::" + query) | node.contains("::" + query + "::")
    variant = (N.normalize_name(name) == N.normalize_name(F.lit(query))) | (F.lower(name) == low)
    tier = F.when(exact, 1).when(variant, 2)
    if fuzzy and "::" not in query and len(query) >= 3:
        tier = tier.when(F.lower(name).startswith(low) | F.lower(node).contains("::" + low) | F.lower(node).endswith(low), 3)
    return tier


def lookup(nodes: DataFrame, query: str, fuzzy: bool = True) -> DataFrame:
    """The nodes of the best tier that has any."""
    if not query.strip():
        return nodes.limit(0).withColumn("tier", F.lit(0))
    hits = nodes.withColumn("tier", name_tier(query, fuzzy)).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")  # best: one row


def call_targets(nodes: DataFrame, query: str, fuzzy: bool = False) -> DataFrame:
    """The targets that stand for a name: its nodes, and references to it."""
    base = query.split("::")[-1].split(".")[-1]
    ids = lookup(nodes, query, fuzzy).select(F.col("id").alias("target"))
    same = nodes.where(F.col("id").endswith("::" + query) | F.col("id").endswith("::" + base)).select(F.col("id").alias("target"))
    refs = nodes.sparkSession.createDataFrame([(t,) for t in dict.fromkeys([query, f"REF:{query}", f"REF:{base}"])], "target string")
    return ids.unionByName(same).unionByName(refs).distinct()


def _callers(nodes: DataFrame, edges: DataFrame, query: str, fuzzy: bool) -> DataFrame:
    base = query.split("::")[-1].split(".")[-1]
    calls = edges.where(F.col("relation").isin(CALLS))
    suffix = F.col("target").endswith("::" + base) | F.col("target").endswith("." + base)
    if fuzzy and len(query) >= 3:
        suffix = suffix | F.substring_index(F.substring_index(F.expr("substring(target, 5)"), "::", -1), ".", -1).startswith(query)
    refers = calls.where(F.col("target").startswith("REF:") & suffix)
    return calls.join(call_targets(nodes, query, fuzzy), "target", "left_semi").unionByName(refers).select(F.col("source").alias("id")).distinct()


def callers(nodes: DataFrame, edges: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """G1: who calls a name, with what is known of each caller; names that begin with it only if none has it."""
    hits = cut(_callers(nodes, edges, query, False))
    if hits.isEmpty():
        hits = _callers(nodes, edges, query, True)
    out = hits.join(nodes.select("id", "name", "type", "token_count"), "id", "left")
    return out.orderBy("id").limit(limit) if limit else out


def callees(nodes: DataFrame, edges: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """What the first function or method of that name calls, once each, in the order of the calls."""
    start = lookup(nodes.where(F.col("type").isin("Function", "Method")), query, fuzzy=False).orderBy("ord").limit(1).select(F.col("id").alias("source"))
    calls = edges.where(F.col("relation").isin("CALLS", "CALLS_RESOLVED")).join(start, "source", "left_semi")
    key = F.when(F.col("target").startswith("REF:"), F.concat(F.lit("REF:"), N.clean_ref(F.expr("substring(target, 5)")))).otherwise(F.col("target"))
    out = calls.groupBy(key.alias("callee")).agg(F.min("ord").alias("ord"))
    return out.orderBy("callee").limit(limit) if limit else out


def callers_summary(nodes: DataFrame, edges: DataFrame, target: str, limit: int = 15) -> DataFrame:
    """O3: the callers of a node, smallest first."""
    ids = edges.where(F.col("relation").isin(CALLS) & (F.col("target") == target)).select(F.col("source").alias("id")).distinct()
    return ids.join(nodes, "id").select("id", "name", "token_count").orderBy("token_count", "name", "id").limit(limit)


def similar_nodes(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """O2: candidates for an id that isn't there, by symbol, class and path."""
    parts = query.replace("FILE:", "").split("::")
    symbol, klass = parts[-1], parts[-2] if len(parts) > 1 else None
    wanted = N.normalize_name(F.lit(symbol))
    own, node_parts = N.normalize_name(F.col("name")), F.split(F.regexp_replace("id", "FILE:", ""), "::")
    part_of = F.char_length(wanted) >= 2
    score = F.when(F.col("name") == symbol, 100).when(own == wanted, 80).when(part_of & (F.contains(own, wanted) | F.contains(wanted, own)), 40).otherwise(0)
    if klass:
        node_class = F.when((F.col("type") == "Method") & (F.size(node_parts) >= 2), F.element_at(node_parts, -2))
        score = score + F.coalesce(F.when(node_class == klass, 50).when(N.normalize_name(node_class) == N.normalize_name(F.lit(klass)), 40), F.lit(0))
        score = score + F.when(F.regexp_replace("id", "FILE:", "").contains(query.replace("FILE:", "")), 30).otherwise(0)
    rows = nodes.where("type <> 'File'").select("id", "name", "type", score.alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), "name", "id").limit(limit)


def structure(nodes: DataFrame, edges: DataFrame, file_id: str, shown: int = 15) -> DataFrame:
    """How many names a file holds, by type, and the first of them."""
    inside = nodes.where(F.col("id").startswith(file_id + "::")).groupBy("type", "name").agg(F.count("*").alias("n"))
    ranked = inside.withColumn("k", F.row_number().over(W.partitionBy("type").orderBy("name")))
    return ranked.groupBy("type").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.col("name")))), ",").alias("shown"))


def impls(nodes: DataFrame, method: str, trait: str | None = None) -> DataFrame:
    """Implementations of a trait's method, a row each, with how many the trait has."""
    hit = F.col("type").isin("Method", "Function") & (F.col("name") == method) & (F.coalesce("trait_impl", F.lit("")) != "")
    hit = hit & (F.col("trait_impl") == trait) if trait else hit
    found = nodes.where(hit).select("trait_impl", "id")
    return found.join(found.groupBy("trait_impl").agg(F.count("*").alias("n")), "trait_impl")


def ancestors(edges: DataFrame, depth: int = 5) -> DataFrame:
    """Every class with its ancestors and how far up they are, to a bounded depth (levels are joins of the plan, not driver steps)."""
    up = edges.where("relation = 'INHERITS'").select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct()
    level = up.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    out = level
    for k in range(2, depth + 1):
        level = level.join(up, level["ancestor"] == up["child"]).select("id", F.col("parent").alias("ancestor"), F.lit(k).alias("steps"))
        out = out.unionByName(level)
    return out.groupBy("id", "ancestor").agg(F.min("steps").alias("steps"))


def flatten(nodes: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """The methods of every class with those it inherits; the nearest definition of a name wins, the first of equals."""
    classes = nodes.where("type = 'Class'").select("id")
    chain = classes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps")).unionByName(ancestors(edges, depth))
    methods = nodes.where("type = 'Method'").select(F.col("id").alias("method"), "name", "ord")
    owned = edges.where("relation = 'DEFINES'").select(F.col("source").alias("ancestor"), F.col("target").alias("method")).distinct().join(methods, "method")
    return first_of(chain.join(owned, "ancestor"), ["id", "name"], ["steps", "ord"]).select("id", "name", "method", "steps")


def reachable(edges: DataFrame, starts: DataFrame, relations: list[str], depth: int = 3) -> DataFrame:
    """Nodes within depth calls of the starts (id), with the shortest path, ties by the order of its edges.

    Each level is written down, and only the edges of its nodes are grouped.
    """
    called = edges.where(F.col("relation").isin(relations)).select("source", "target", "ord")
    level = cut(starts.select("id", F.array(F.col("id")).alias("path"), F.array().cast("array<bigint>").alias("ords"), F.lit(0).alias("steps")))
    seen = level
    for k in range(1, depth + 1):
        step = level.join(called, level["id"] == called["source"]).groupBy("id", "path", "ords", "target").agg(F.min("ord").alias("ord"))
        new = step.select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"), F.concat("ords", F.array("ord")).alias("ords"), F.lit(k).alias("steps"))
        new = new.groupBy("id").agg(F.min_by(F.struct("path", "ords", "steps"), F.struct("ords", "path")).alias("b")).select("id", "b.*")
        level = cut(new.join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(level)
    return seen


def usage_examples(edges: DataFrame, name: str, limit: int = 3) -> DataFrame:
    """Calls of a name, from examples first, then tests."""
    callee = F.regexp_replace("target", "^REF:", "")
    hit = F.col("relation").isin("CALLS", "CALLS_RESOLVED") & ((callee == name) | callee.endswith("." + name) | callee.endswith("::" + name))
    rank = F.when(F.lower("source").contains("example"), 0).when(F.lower("source").contains("test"), 1).otherwise(2)
    return edges.where(hit).withColumn("rank", rank).orderBy("rank", "ord").limit(limit).select("ord", "source", "target", "rank")


def related_tests(nodes: DataFrame, name: str, file: str | None = None, limit: int = 5) -> DataFrame:
    """Test files of a source file (four patterns), then test functions of a name, by its snake_case too, or in the same file."""
    snake = re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()
    base, dot, ext = (file or name).rsplit("/", 1)[-1].rpartition(".") if file else (name, ".", "")
    files = [f"test_{base}{dot}{ext}", f"{base}_test{dot}{ext}", f"{base}.test{dot}{ext}", f"{base}.spec{dot}{ext}"]
    of_file = F.col("name").isin(files) if file else N.either([F.col("name").startswith(x) for x in files])
    direct = F.col("name").isin(f"test_{name}", f"test_{snake}")
    if file:
        direct = direct | F.col("name").startswith("test_") & F.col("name").contains(snake) & F.col("id").contains(file)
    kind = F.when((F.col("type") == "File") & of_file, 0).when(F.col("type").isin("Function", "Method") & direct, 1)
    return nodes.withColumn("kind", kind).where("kind IS NOT NULL").orderBy("kind", "ord").limit(limit).select("id", "name", "type")


def related_configs(nodes: DataFrame, edges: DataFrame, file_id: str, but: str | None = None, limit: int = 5) -> DataFrame:
    """F16: the configurations that a file defines, by line."""
    own = edges.where((F.col("source") == file_id) & (F.col("relation") == "DEFINES")).select(F.col("target").alias("id")).distinct()
    found = nodes.where((F.col("type") == "Configuration") & ~F.col("id").eqNullSafe(but)).join(own, "id", "left_semi")
    return found.orderBy("lineno", "ord").limit(limit).select("id", "name", "signature", "lineno")


def imports(edges: DataFrame, shown: int = 10) -> DataFrame:
    """How many distinct modules each file imports, and the first of them."""
    names = F.array_sort(F.collect_set(F.regexp_replace("target", "^MODULE:", "")))
    return edges.where("relation = 'IMPORTS'").groupBy(F.col("source").alias("id")).agg(names.alias("all")).select("id", F.size("all").alias("n"), F.array_join(F.slice("all", 1, shown), ", ").alias("shown"))


def definitions(nodes: DataFrame, edges: DataFrame, shown: int = 15) -> DataFrame:
    """A10: what each file defines itself, by type: how many, and the first names (configurations: signatures by line)."""
    own = edges.where("relation = 'DEFINES'").select(F.col("source").alias("file"), F.col("target").alias("id")).distinct().join(nodes, "id").where(F.col("file").startswith("FILE:") & ~F.col("file").contains("::"))
    own = own.where(F.col("type").isin("Constant", "Class", "Function", "Configuration"))
    order = F.when(F.col("type") == "Configuration", F.coalesce("lineno", F.lit(0))).otherwise(0)
    text = F.when(F.col("type") == "Configuration", F.coalesce("signature", "name")).otherwise(F.col("name"))
    rows = own.withColumns({"at": order, "text": text}).withColumn("k", F.row_number().over(W.partitionBy("file", "type").orderBy("at", "text")))
    return rows.groupBy("file", "type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", "text")))), lambda x: x["text"]), ", ").alias("shown"))


def symbols_by_file(nodes: DataFrame) -> DataFrame:
    """Symbols of each file."""
    return nodes.where(F.col("id").contains("::")).groupBy(N.file_of(F.col("id")).alias("file")).agg(F.count("*").alias("symbols"))


def shared_names(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Names that several methods have."""
    return nodes.where("type = 'Method'").groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def call_in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1 for calls alone."""
    return in_degree(nodes, edges.where(F.col("relation").isin(CALLS))).withColumnRenamed("in_degree", "call_in_degree")


def class_children(nodes: DataFrame) -> DataFrame:
    """Each class's methods by line."""
    methods = nodes.where("type = 'Method'").withColumn("class_id", F.regexp_replace("id", "::[^:]*$", ""))
    classes = nodes.where("type = 'Class'").select(F.col("id").alias("class_id"))
    own = methods.join(classes, "class_id", "left_semi")
    return own.groupBy("class_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "ord", "name"))), lambda m: m["name"]), ",").alias("methods"))


def prioritised(nodes: DataFrame) -> DataFrame:
    """Of nodes with the same name, the one to show."""
    return first_of(nodes.withColumn("rank", N.type_rank(F.col("type"))), ["name"], ["rank", "ord"]).select("name", "id", "rank")


def greedy_budget(items: DataFrame, key: str, budget: int) -> DataFrame:
    """In order, take what still fits and skip (not stop at) what doesn't. items: key, ord, id, token_count.

    What is left only shrinks, so of the items of one size a prefix is taken, of at most budget / size of them: no more is gathered
    than budget * ln(budget) items a key, whatever the key has.
    """
    size = F.col("token_count").cast("int")
    rank = F.row_number().over(W.partitionBy(key, "t").orderBy("ord", "id"))
    able = items.withColumn("t", size).where((F.col("t") > 0) & (F.col("t") <= budget)).withColumn("k", rank).where((F.col("k") <= budget) & (F.col("k") * F.col("t") <= budget))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "id", "t")))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("ids"))
    fold = F.aggregate("all", start, lambda s, x: F.when(x["t"] <= s["left"], F.struct((s["left"] - x["t"]).alias("left"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s))
    taken = able.groupBy(key).agg(ordered.alias("all")).withColumn("s", fold).select(F.col(key).alias("__key"), "s")
    keys = items.select(key).distinct().join(taken, F.col(key).eqNullSafe(F.col("__key")), "left")
    return keys.select(key, F.coalesce("s.left", F.lit(budget)).alias("budget_left"), F.coalesce(F.array_join("s.ids", ","), F.lit("")).alias("taken"))


def examples(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """well-connected symbols worth showing."""
    named = nodes.where((F.coalesce("name", F.lit("")) != "") & ~F.col("name").startswith("_") & ~F.lower("id").contains("test"))
    return in_degree(named, edges).where(F.col("type").isin("Function", "Method", "Class")).orderBy(F.desc("in_degree"), "id").limit(limit).select("id", "type", "in_degree")


def showcase(nodes: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """kind, place, name, n of symbols and files worth showing for each tool: most called, most calling, most symbols, most shared method names."""
    named = nodes.where((F.coalesce("name", F.lit("")) != "") & ~F.col("name").startswith("_") & ~F.lower("id").contains("test"))
    functions = named.where("type = 'Function'").select("id", "name")
    most = lambda df, kind, name, n: numbered(df.orderBy(F.desc(n), name).limit(limit).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(n).cast("long").alias("n")), "place", F.desc("n"), "name")
    called = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).join(functions, "id")
    calling = out_degree(edges).join(functions, "id")
    out = most(called, "called", "id", "n").unionByName(most(calling.where("out_degree >= 2"), "calling", "id", "out_degree"))
    return out.unionByName(most(symbols_by_file(nodes), "files", "file", "symbols")).unionByName(most(shared_names(named), "methods", "name", "n"))


def with_imports(refs: DataFrame, imported: DataFrame) -> DataFrame:
    """Refs (file, ref) with full_name: the first part of a dotted name stands for the module that the file imported under it (file, alias, module)."""
    first = F.substring_index("ref", ".", 1)
    rest = F.expr("substring(ref, char_length(substring_index(ref, '.', 1)) + 1)")
    out = refs.withColumn("alias", first).join(imported, ["file", "alias"], "left")
    return out.withColumn("full_name", F.when(F.col("module").isNotNull(), F.concat("module", rest)).otherwise(F.col("ref"))).drop("alias", "module")
