"""Shared storage: what cuts lineage there, and numbering of rows in a global order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where none is set on a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to shared storage and go on from there: later steps neither recompute it nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in shared storage: like cut, for tables that are large and shrink when they are packed."""
    folder = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with a number from 0 in a global order. Rows are sorted by ranges; only the counts of the ranges (one row a task) meet."""
    rows = cut(df.orderBy(*order)).withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__range"), F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")
