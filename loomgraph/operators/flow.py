"""Depth-first views of calls: the flow tree and the expansion of callees.

Both are bounded by design (depth, children of a node, nodes), so the walks below a start are a bounded table: at most
children ** depth rows. They are made level by level with joins, and folded in the order in which a depth-first visit meets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.operators import graph
from loomgraph.operators.resolve import last_part
from loomgraph.storage import cut

CHILDREN, NODES, DEPTH = 10, 100, 3
INLINE = 100


def next_callees(edges: DataFrame, level: DataFrame) -> DataFrame:
    """id, child, rank of what each node of a level calls: once each (references by their short name), in the order of the calls."""
    calls = edges.where(F.col("relation").isin("CALLS", "CALLS_RESOLVED")).select("source", "target", "ord")
    short = F.when(F.col("target").startswith("REF:"), F.concat(F.lit("REF:"), N.clean_ref(F.expr("substring(target, 5)")))).otherwise(F.col("target"))
    # a level has at most CHILDREN ** DEPTH nodes
    found = calls.join(F.broadcast(level.select("id").distinct()), F.col("source") == F.col("id")).groupBy("id", short.alias("key")).agg(F.min_by("target", "ord").alias("child"), F.min("ord").alias("at"))
    return found.select("id", "child", F.row_number().over(W.partitionBy("id").orderBy("at", "child")).alias("rank"))


def next_callers(nodes: DataFrame, edges: DataFrame, level: DataFrame) -> DataFrame:
    """id, child, rank of who calls any symbol with the name of a node of a level, by id."""
    named = level.select("id").distinct().join(nodes.select("id", "name"), "id").select("id", "name")
    calls = edges.where(F.col("relation").isin(graph.CALLS)).select("source", "target")
    # a level has at most CHILDREN ** DEPTH names
    by_name = calls.join(F.broadcast(named), last_part(F.regexp_replace("target", "^REF:", "")) == F.col("name")).select("id", "source")
    same = nodes.select(F.col("id").alias("target"), "name").join(F.broadcast(named), "name").select("id", "target")
    found = by_name.unionByName(calls.join(same, "target").select("id", "source")).distinct()
    return found.select("id", F.col("source").alias("child"), F.row_number().over(W.partitionBy("id").orderBy("source")).alias("rank"))


def walks(nodes: DataFrame, edges: DataFrame, start: DataFrame, direction: str = "forward", depth: int = DEPTH, children: int = CHILDREN) -> DataFrame:
    """key (ranks from the start on), id, steps of every walk from the start (id, one row) over the first children of each node."""
    level = cut(start.select(F.array().cast("array<int>").alias("key"), "id").limit(1))
    out = level.withColumn("steps", F.lit(1))
    for k in range(2, depth + 1):
        found = next_callees(edges, level) if direction == "forward" else next_callers(nodes, edges, level)
        level = cut(level.join(found.where(F.col("rank") <= children), "id").select(F.concat("key", F.array("rank")).alias("key"), F.col("child").alias("id")))
        out = out.unionByName(level.withColumn("steps", F.lit(k)))
    return out.join(F.broadcast(out.select("id").distinct()).join(nodes.select("id", "name", "type", "token_count"), "id"), "id", "left")


def _folded(rows: DataFrame, items: Column, state: str, step) -> DataFrame:
    """One row: the state after all walks, in depth-first order (at most children ** depth of them)."""
    ordered = rows.agg(F.array_sort(F.collect_list(items)).alias("all"))
    return ordered.select(F.aggregate("all", F.expr(state), step).alias("s"))


def _below(key: Column, blocked: Column) -> Column:
    return blocked.isNotNull() & (F.slice(key, F.lit(1), F.size(blocked)) == blocked)


def tree(nodes: DataFrame, edges: DataFrame, start: DataFrame, direction: str = "forward", depth: int = DEPTH, target: str | None = None, children: int = CHILDREN, most: int = NODES) -> DataFrame:
    """Ord, id, steps, parent of the nodes of the call tree in the order of a depth-first visit, each node once.

    The first children of a node are taken before it is known which were visited; a reference without a node counts as visited but isn't
    shown. With a target, the visit ends at the first node of that name, which isn't shown.
    """
    rows = walks(nodes, edges, start, direction, depth, children)
    state = "named_struct('seen', CAST(array() AS array<string>), 'blocked', CAST(NULL AS array<int>), 'out', CAST(array() AS array<struct<key:array<int>,id:string>>), 'done', false)"

    def step(s: Column, x: Column) -> Column:
        struct = lambda seen, blocked, out, done: F.struct(seen.alias("seen"), blocked.alias("blocked"), out.alias("out"), done.alias("done"))
        skip = s["done"] | _below(x["key"], s["blocked"])
        stop = F.array_contains(s["seen"], x["id"]) | (F.size(s["seen"]) >= most)
        seen = F.concat(s["seen"], F.array(x["id"]))
        found = F.coalesce(x["name"] == target, F.lit(False)) if target else F.lit(False)
        shown = F.concat(s["out"], F.array(F.struct(x["key"].alias("key"), x["id"].alias("id"))))
        entered = F.when(x["name"].isNull(), struct(seen, x["key"], s["out"], s["done"])).when(found, struct(seen, s["blocked"], s["out"], F.lit(True))).otherwise(struct(seen, F.lit(None).cast("array<int>"), shown, s["done"]))
        return F.when(skip, s).when(stop, struct(s["seen"], x["key"], s["out"], s["done"])).otherwise(entered)

    folded = _folded(rows, F.struct("key", "id", "name"), state, step).select(F.posexplode("s.out").alias("ord", "x")).select("ord", "x.*")
    up = folded.select(F.col("key").alias("up"), F.col("id").alias("parent"))
    above = F.slice("key", F.lit(1), F.greatest(F.lit(0), F.size("key") - 1))
    return folded.withColumn("up", F.when(F.size("key") > 0, above)).join(up, "up", "left").select("ord", "id", (F.size("key") + 1).alias("steps"), "parent")


def expansion(nodes: DataFrame, edges: DataFrame, start: DataFrame, budget: int, depth: int = 1, inline: int = INLINE, children: int = CHILDREN, most: int = NODES) -> DataFrame:
    """Ord, id, steps, mode of the callees below a node: "inline" where the code is small and fits what is left of the budget, "summary", or "external" without a node.

    Only what is below an inlined node is expanded further; each node once.
    """
    rows = walks(nodes, edges, start, "forward", depth + 1, children)
    state = f"named_struct('seen', transform(array(CAST(NULL AS string)), x -> CAST('' AS string)), 'blocked', CAST(NULL AS array<int>), 'out', CAST(array() AS array<struct<key:array<int>,id:string,mode:string>>), 'left', CAST({int(budget)} AS bigint))"

    def step(s: Column, x: Column) -> Column:
        struct = lambda seen, blocked, out, left: F.struct(seen.alias("seen"), blocked.alias("blocked"), out.alias("out"), left.alias("left"))
        none = F.lit(None).cast("array<int>")
        tokens = F.coalesce(x["token_count"], F.lit(999)).cast("bigint")
        mode = F.when(x["name"].isNull(), "external").when((tokens <= inline) & (tokens <= s["left"]), "inline").otherwise("summary")
        seen = F.concat(s["seen"], F.array(x["id"]))
        out = F.concat(s["out"], F.array(F.struct(x["key"].alias("key"), x["id"].alias("id"), mode.alias("mode"))))
        left = F.when(mode == "inline", s["left"] - tokens).otherwise(s["left"])
        # the state's first place of seen is no node, so its size is one more than the nodes seen
        goes_on = (mode == "inline") & (left > 0) & (F.size(seen) - 1 < most)
        root = struct(F.concat(s["seen"], F.array(x["id"])), F.when(s["left"] > 0, none).otherwise(x["key"]), s["out"], s["left"])
        return F.when(_below(x["key"], s["blocked"]), s).when(F.size(x["key"]) == 0, root).when(F.array_contains(s["seen"], x["id"]), struct(s["seen"], x["key"], s["out"], s["left"])).otherwise(struct(seen, F.when(goes_on, none).otherwise(x["key"]), out, left))

    folded = _folded(rows, F.struct("key", "id", "name", "token_count"), state, step)
    return folded.select(F.posexplode("s.out").alias("ord", "x")).select("ord", "x.id", F.size("x.key").alias("steps"), "x.mode")
