"""Requests to endpoints and handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names as N

# Prefixes that a client may put before a path, tried in this order.
PREFIXES = ["/api/v1", "/api/v2", "/api"]


def stripped(path):
    """The path without the first prefix that begins it."""
    out = path
    for p in reversed(PREFIXES):
        out = F.when(path.startswith(p), F.substr(path, F.lit(len(p) + 1))).otherwise(out)
    return F.when(out == "", "/").otherwise(out)


def match(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The endpoint of each request (id, method, path): exact, then by template, then both again without a prefix.

    endpoints: ord, method, path, operation. Endpoints are joined by their literal segments: a shape says which segments of a template
    have a parameter, and a request is looked up once for each shape of its method and length, with these segments left out. Of several the first in the specification wins.
    """
    segments = F.split("path", "/")
    open_ = lambda s: s.rlike(r"\{[^}]*\}")
    spec = endpoints.select("ord", "method", F.col("path").alias("template"), "operation", segments.alias("parts"), F.size(segments).alias("n"), F.transform(segments, open_).alias("shape"))
    literal = lambda parts, shape: F.array_join(F.zip_with(parts, shape, lambda p, o: F.when(o, "{}").otherwise(p)), "/")
    spec = spec.withColumn("key", literal("parts", "shape"))
    shapes = spec.select("method", "n", "shape").distinct()  # far fewer than endpoints
    tries = F.array_compact(F.array(F.struct(F.lit(0).alias("try"), F.col("path")), F.when(stripped(F.col("path")) != F.col("path"), F.struct(F.lit(1).alias("try"), stripped(F.col("path")).alias("path")))))
    tried = requests.select("id", "method", F.explode(tries).alias("t")).select("id", "method", "t.*").withColumns({"own": segments, "n": F.size(segments)})
    asked = tried.join(shapes, ["method", "n"]).withColumn("key", literal("own", "shape"))
    hits = asked.join(spec.drop("n"), ["method", "shape", "key"])
    # a segment with a parameter: its other characters as they are, at least one character for each parameter
    pattern = lambda s: F.concat(F.lit("^\\Q"), F.regexp_replace(F.regexp_replace(s, r"\\E", r"\\E\\\\E\\Q"), r"\{[^}]*\}", r"\\E[^/]+\\Q"), F.lit("\\E$"))
    fits = F.forall(F.zip_with(F.zip_with("own", "parts", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "shape", lambda x, o: ~o | F.rlike(x["a"], pattern(x["b"]))), lambda x: x)
    best = F.min_by(F.struct("template", "operation"), F.struct("try", (F.col("path") != F.col("template")).alias("loose"), "ord"))
    found = hits.where(fits).groupBy("id").agg(best.alias("b")).select("id", "b.template", "b.operation")
    return requests.select("id").join(found, "id", "left")


def handlers(endpoints: DataFrame, nodes: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The function of each operation; the last node of a name wins. within (F12): only nodes whose id holds one of these."""
    functions = nodes.where(F.col("type").isin("Function", "Method"))
    if within:
        functions = functions.where(N.either([F.col("id").contains(w) for w in within]))
    last = functions.groupBy(F.col("name").alias("operation")).agg(F.max_by("id", "ord").alias("handler"))
    return endpoints.join(last, "operation", "left")


def listed(endpoints: DataFrame, tag: str | None = None) -> DataFrame:
    """Endpoints with a tag, by path and method."""
    rows = endpoints.where(F.exists("tags", lambda t: F.lower(t) == tag.lower())) if tag else endpoints
    return rows.orderBy("path", "method")


def stats(linked: DataFrame) -> DataFrame:
    """A13"""
    return linked.agg(F.count("*").alias("endpoints"), F.countDistinct(F.when(F.col("handler").isNotNull(), F.col("operation"))).alias("linked"))
