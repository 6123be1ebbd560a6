"""An extension beyond the batch operators: churn over a stream of commits, by event time with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import shared_dir


def windowed_churn(commits: DataFrame, time: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Changes by window and key. State of windows older than the watermark is dropped, so it is bounded by late + window."""
    return commits.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("changes")).select(F.col("w.start").alias("since"), key, "changes")


def replay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Run a Parquet table through the stream once; the result table of the run.

    Each batch writes the windows that it changed to a folder of its own (so a repeated batch replaces its rows); of each window the last batch counts.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(spark)}/churn-{uuid.uuid4().hex}"

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    query = windowed_churn(stream, "ts", "event_type").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.parquet(f"{out}/rows").groupBy("since", "event_type").agg(F.max_by("changes", "batch").alias("changes"))
