"""Resolution of references to nodes by prioritised keys, and the filter of calls outside the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions.vocabulary import PREFIXES, STDLIB

# Words that stand for the type or object that a method belongs to.
SELF_LIKE = ["Self", "self", "static", "parent", "this"]
#: Strategies in the order in which they are tried.
STRATEGIES = ["index", "qualified", "self", "file", "name"]


def bare(callee: Column) -> Column:
    """The callee without generic arguments (four levels deep) and trailing colons."""
    for _ in range(4):
        callee = F.regexp_replace(callee, "<[^<>]*>", "")
    return F.regexp_replace(F.regexp_replace(callee, ":{3,}", "::"), ":+$", "")


def last_part(name: Column) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(name, ".", -1), "::", -1), "->", -1)


def begins(callee: Column, prefixes: list[str]) -> Column:
    """Whether a callee begins with one of many prefixes: those of one part by a look-up of its first part, the others one by one."""
    first = {end: [p for p in prefixes if p.endswith(end) and p.count(".") + p.count("::") == 1] for end in (".", "::")}
    rest = [p for p in prefixes if p not in first["."] and p not in first["::"]]
    looked = [F.contains(callee, F.lit(end)) & F.concat(F.substring_index(callee, end, 1), F.lit(end)).isin(ps) for end, ps in first.items() if ps]
    return N.either([F.lit(False), *looked, *(callee.startswith(p) for p in rest)])


def non_project(callee: Column, words: list[str] = STDLIB, prefixes: list[str] = PREFIXES) -> Column:
    """whether a call leaves the project."""
    b = F.when(callee.contains("<"), bare(callee)).otherwise(callee)
    in_prefix = begins(callee, prefixes)
    two = F.split(callee, "::")
    column = (F.size(two) == 2) & F.get(two, F.lit(1)).contains(".") & F.get(two, F.lit(0)).rlike("^[^A-Z]*[a-z][^A-Z]*$") & F.substring_index(F.get(two, F.lit(1)), ".", 1).rlike("^[^A-Z]*[a-z][^A-Z]*$")
    owner = F.when(b.contains("::"), F.element_at(F.split(b, "::"), -2)).otherwise("")
    own = (owner != "") & ~owner.isin(SELF_LIKE) & ~owner.isin(words) & ~in_prefix
    return F.when(callee.isin(words) | column, True).when(own, False).otherwise(last_part(b).isin(words) | in_prefix)


def named_by(nodes: DataFrame) -> DataFrame:
    """kind, key, id: the first node of each way to name one: by type and name, by scope and name, by file and name, by name."""
    plain = nodes.where("type <> 'File'").select("id", "name", "ord", F.split("id", "::").alias("parts"))
    scope = F.when(F.size("parts") > 2, F.element_at("parts", -2))
    keys = {"qualified": F.concat_ws("::", scope, "name"), "self": F.when(scope.isNotNull(), F.concat_ws("::", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "::"), "name")), "file": F.concat_ws("::", F.get("parts", F.lit(0)), "name"), "name": F.col("name")}
    keys["qualified"] = F.when(scope.isNotNull(), keys["qualified"])
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()])
    return plain.select("id", "ord", F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("p")).groupBy("p.kind", "p.key").agg(F.min_by("id", "ord").alias("resolved"))


def references(edges: DataFrame, words: list[str] = STDLIB) -> DataFrame:
    """ord, source, target, ref of the references that stay in the project."""
    ref = F.expr("substring(target, 5)")
    return edges.where(F.col("target").startswith("REF:") & ~non_project(ref, words)).select("ord", "source", "target", ref.alias("ref"))


def resolve(nodes: DataFrame, edges: DataFrame, words: list[str] = STDLIB, index: DataFrame | None = None) -> DataFrame:
    """References with `resolved`, `strategy`: by a symbol index (ord, candidate), then qualified type and method, then self.method in its own scope, then the bare name in its own file, then the bare name anywhere.

    Each reference asks for its keys in one join, against one row a key: a common name meets one row, not all its nodes. A candidate of the
    index counts if it lies in the same top folder or its name is part of the reference.
    """
    refs = references(edges, words).withColumns({"name": last_part(F.col("ref")), "of": F.when(F.col("ref").contains("::"), F.element_at(F.split("ref", "::"), -2))})
    plain = F.col("of").isNull()
    asked = {
        "qualified": F.when(~plain, F.concat_ws("::", "of", "name")),
        "self": F.when(F.col("ref").rlike(r"^(self|this)\."), F.concat_ws("::", F.regexp_replace("source", "::[^:]*$", ""), "name")),
        "file": F.when(plain, F.concat_ws("::", F.substring_index("source", "::", 1), "name")),
        "name": F.when(plain, F.col("name")),
    }
    keys = F.filter(F.array(*[F.struct(F.lit(STRATEGIES.index(k)).alias("try"), F.lit(k).alias("kind"), v.alias("key")) for k, v in asked.items()]), lambda p: p["key"].isNotNull())
    tried = refs.select("ord", "source", "target", F.posexplode_outer(keys).alias("pos", "k")).select("ord", "source", "target", (F.coalesce("pos", F.lit(0)) == 0).alias("once"), "k.*")
    found = tried.join(named_by(nodes), ["kind", "key"], "left").select("ord", "source", "target", "once", "try", "resolved")
    if index is not None:
        top = lambda c: F.substring_index(N.file_of(F.col(c)), "/", 1)
        known = index.join(nodes.select(F.col("id").alias("candidate"), F.col("name").alias("known")), "candidate")
        near = refs.join(known, "ord").where((top("candidate") == top("source")) | F.contains(F.lower("ref"), F.lower("known")))
        found = found.unionByName(near.select("ord", "source", "target", F.lit(False).alias("once"), F.lit(0).alias("try"), F.col("candidate").alias("resolved")))
    best = F.min_by(F.struct("try", "resolved"), F.when(F.col("resolved").isNotNull(), F.col("try")))
    out = found.groupBy("ord", "source", "target").agg(best.alias("b"), F.count_if("once").cast("int").alias("rows"))
    out = out.select("ord", "source", "target", "b", F.explode(F.array_repeat(F.lit(1), F.col("rows"))))  # rows that repeat stay
    strategy = F.when(F.col("b.resolved").isNull(), "none").otherwise(F.get(F.array(*map(F.lit, STRATEGIES)), F.col("b.try")))
    return out.select("ord", "source", "target", F.col("b.resolved").alias("resolved"), strategy.alias("strategy"))


def resolution_stats(resolved: DataFrame, by: Column | None = None) -> DataFrame:
    """How many references each strategy resolved and their share; with `by` (a language, say) attempted and resolved of each."""
    if by is not None:
        out = resolved.groupBy(by.alias("lang")).agg(F.count("*").alias("attempted"), F.count("resolved").alias("resolved"))
        return out.withColumn("percent", F.round(100 * F.col("resolved") / F.col("attempted"), 1))
    counts = resolved.groupBy("strategy").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("strategy", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))
