"""Sinks besides graphs: embedding caches, manifests of projects, JSON rows, fenced text, progress events, repeated answers."""

from __future__ import annotations

import secrets
import uuid
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def save_vectors(vectors: DataFrame, path: str, key: str) -> None:
    """K2: vectors (id, text, vector) of one state of a graph, under its key. Readers see a folder only with the marker that the writer leaves last; others are dropped then."""
    spark = vectors.sparkSession
    folder = f"{path}/key={key}-{uuid.uuid4().hex[:8]}"
    vectors.select("id", "text", "vector").write.parquet(folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
        if entry.getPath().getName().startswith("key=") and entry.getPath().getName() != folder.rsplit("/", 1)[-1]:
            fs.delete(entry.getPath(), True)


def load_vectors(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The vectors that were saved under a key, if they are whole: every text has a vector, all of one length. Else None."""
    if not _exists(spark, path):
        return None
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [e.getPath().getName() for e in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)]
    for name in (n for n in names if n.startswith(f"key={key}-") and _exists(spark, f"{path}/{n}/_SUCCESS")):
        rows = spark.read.parquet(f"{path}/{name}")
        sizes = rows.agg(F.count_if(F.col("vector").isNull() | F.col("text").isNull()).alias("bad"), F.countDistinct(F.size("vector")).alias("sizes")).first()
        if not sizes["bad"] and sizes["sizes"] <= 1:
            return rows
    return None


def to_build(projects: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """K3, ST2: the projects (lang, project, hash) whose hash the manifest doesn't have."""
    return projects if manifest is None else projects.join(manifest, ["lang", "project", "hash"], "left_anti")


def merged_manifest(manifest: DataFrame | None, built: DataFrame) -> DataFrame:
    """K3: the manifest with the projects just built in place of their older rows."""
    return built if manifest is None else manifest.join(built, ["lang", "project"], "left_anti").unionByName(built)


def as_json(df: DataFrame) -> DataFrame:
    """K5: one JSON text for each row; nulls are kept."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def fenced(text: str, tag: str = "repository-content") -> str:
    """K7: text of a repository between marks that it can't know before; empty text stays empty."""
    return f'<{tag} id="{secrets.token_hex(6)}">\n{text}\n</{tag}>' if text else text


def events(steps: Iterator[tuple[str, int]]) -> Iterator[str]:
    """K6: server-sent events of a run: start, one for each step (name, rows), done or error."""
    yield "event: start\ndata: {}\n\n"
    try:
        for name, rows in steps:
            yield f'event: output\ndata: {{"step": "{name}", "rows": {rows}}}\n\n'
    except Exception as e:  # the stream tells of any failure and ends
        yield f'event: error\ndata: {{"error": "{type(e).__name__}"}}\n\n'
        raise
    yield "event: done\ndata: {}\n\n"


class Answered:
    """Which sources were shown for a state of the graph; of more than `most`, the oldest `dropped` go."""

    def __init__(self, most: int = 100, dropped: int = 20):
        self.most, self.dropped, self.seen = most, dropped, OrderedDict()

    def again(self, key: str, version: str) -> str | None:
        found = self.seen.get(key)
        return found[1] if found and found[0] == version else None

    def note(self, key: str, version: str, node_id: str) -> None:
        if len(self.seen) >= self.most:
            for _ in range(min(self.dropped, len(self.seen))):
                self.seen.popitem(last=False)
        self.seen[key] = version, node_id


def fresh(spark: SparkSession, path: str, most_hours: float) -> DataFrame:
    """C17, G17, ST3: exists, age_hours, stale of the graph at a path, by the time of its last pointer."""
    if not _exists(spark, f"{path}/_pointers"):
        return spark.range(1).select(F.lit(False).alias("exists"), F.lit(None).cast("double").alias("age_hours"), F.lit(True).alias("stale"))
    pointers = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/_pointers")
    written = pointers.agg(F.max("version").alias("v")).select((F.substring("v", 2, 20).cast("decimal(20,0)") / 1_000_000_000).cast("double").alias("at"))
    age = (F.unix_micros(F.current_timestamp()) / 1_000_000 - F.col("at")) / 3600
    return written.select(F.lit(True).alias("exists"), age.alias("age_hours"), (age > most_hours).alias("stale"))
