"""What several operators need: lineage cuts in shared storage, and SQL-side local variables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import cut, shared_dir, written

__all__ = ["NO_ID", "cut", "emptied", "filled", "filtered", "let", "released", "removed", "settled", "shared_dir", "task_memory", "tasks_for", "written"]
#: Plan nodes that give each task the same rows in the same order whenever it runs.
SETTLED = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LogicalRDD", "LocalRelation", "Union"}


def settled(df: DataFrame) -> DataFrame:
    """df, written first unless it is a plain reading of stored rows: after a shuffle a repeated task may get its rows in another order."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in SETTLED:
            return cut(df)
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return df


def removed(folder: str) -> None:
    """Delete a folder of shared storage whose rows no later step reads."""
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Collect the garbage of the driver and the executors: only then Spark removes the shuffle files of what is written, and heaps that earlier parts made large shrink."""
    gc.collect()
    spark._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism  # a task for each core, so each executor has some
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


#: Bits of a filter of hashes, 4 MB at most: 3 million keys fill a tenth of them. With many more it lets more through, and what follows is exact anyway.
FILTER_BITS = 1 << 25


def filtered(rows: DataFrame, hashed: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """rows with __maybe: false only where no row of wanted has the same hash (a long). A bounded bitmap goes to the tasks, so rows needn't travel to be told apart."""
    place = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    bits = wanted.select(place(wanted_hash).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))
    at = rows.withColumn("__h", place(hashed)).withColumn("__part", F.bitmap_bucket_number("__h"))
    position = F.bitmap_bit_position("__h")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))), F.lit(2)) == 1
    return at.join(F.broadcast(bits), "__part", "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("__maybe"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even if body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def tasks_for(rows: int, rows_per_task: int) -> int:
    return max(1, -(-rows // rows_per_task))


#: Stands for a null id inside Python functions, where a column of integers can't hold nulls without turning into floats.
NO_ID = -(2**63)


def filled(id_: Column) -> Column:
    return F.coalesce(id_.cast("long"), F.lit(NO_ID))


def emptied(id_: Column) -> Column:
    return F.nullif(id_, F.lit(NO_ID))


@contextmanager
def task_memory(*caches: dict) -> Iterator[None]:
    """Empty what a task has kept and give its memory back when it ends: workers of earlier stages stay, and an executor has several."""
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        gc.collect()
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
