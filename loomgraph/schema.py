"""Tables of the engine and the version gate of graph documents."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
SHARE = 100_000
META = "name string, path string, lineno int, end_lineno int, token_count int, in_degree bigint, signature string, docstring string, source string, value string, trait_impl string, kind string, return_type string, param_types array<string>"
GRAPH = f"schema_version int, share bigint, nodes array<struct<id: string, type: string, metadata: struct<{META.replace(' ', ': ').replace(',:', ',')}>>>, edges array<struct<source: string, target: string, relation: string, metadata: struct<lineno: int, via: string, resolution_source: string>>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph document, or of a folder written by export_graph; refuses any other schema version."""
    doc = spark.read.schema(GRAPH).option("multiLine", path.endswith(".json")).json(path)
    versions = [r[0] for r in doc.select("schema_version").distinct().limit(5).collect()]
    if versions != [SCHEMA_VERSION]:
        raise ValueError(f"graph schema version {versions} is not {SCHEMA_VERSION}; index again")
    ord_ = (F.coalesce("share", F.lit(0)) * SHARE + F.col("pos")).alias("ord")
    nodes = doc.select("share", F.posexplode("nodes").alias("pos", "n")).select(ord_, "n.id", "n.type", "n.metadata.*")
    edges = doc.select("share", F.posexplode("edges").alias("pos", "e")).select(ord_, "e.source", "e.target", "e.relation", "e.metadata.lineno", "e.metadata.via", "e.metadata.resolution_source")
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Sink K1: both tables as Parquet in a folder of their own, which a pointer names once it is whole; a failed write leaves the old graph."""
    spark = nodes.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    nodes.write.parquet(f"{path}/{version}/nodes")
    edges.write.parquet(f"{path}/{version}/edges")
    # the pointer is a folder name: the last one written wins, and it appears in one step when its job commits
    spark.range(1).select(F.lit(version).alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version")).coalesce(1).write.parquet(f"{path}/_pointers/{version}")


def is_saved(spark: SparkSession, path: str) -> bool:
    """Whether write_graph has written here; any file system of Spark's."""
    pointers = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointers")
    return pointers.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointers)


def saved_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the last whole write of write_graph."""
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/_pointers").orderBy(F.desc("version")).first()
    if found is None or found["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"graph schema version {found and found['schema_version']} is not {SCHEMA_VERSION}; index again")
    return tuple(spark.read.parquet(f"{path}/{found['version']}/{name}") for name in ("nodes", "edges"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Sink K1: the graph as a document that read_graph loads. One JSON line holds nodes or edges of one task's share, so no task has all of them."""
    named = [c.split()[0] for c in META.split(", ")]
    meta = lambda df, names: F.struct(*[F.col(c) for c in names if c in df.columns])
    n = nodes.select("ord", F.struct("id", "type", meta(nodes, named).alias("metadata")).alias("n"))
    e = edges.select("ord", F.struct("source", "target", "relation", meta(edges, ["lineno", "via", "resolution_source"]).alias("metadata")).alias("e"))
    share = F.expr(f"ord div {SHARE}").alias("share")
    parts = n.groupBy(share).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "n"))), lambda x: x["n"]).alias("nodes"))
    links = e.groupBy(share).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"]).alias("edges"))
    both = parts.join(links, "share", "full_outer").select(F.lit(SCHEMA_VERSION).alias("schema_version"), "share", "nodes", "edges")
    both.write.mode("errorifexists").json(path)
