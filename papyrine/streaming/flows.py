"""The same operators over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.sources.sinks import append_rows


def stream_rows(spark: SparkSession, path: str, schema: str, transform: Callable[[DataFrame], DataFrame], headers: list[str], target: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Every new file under ``path`` through ``transform`` (which gives a ``hash``) to the target, once per hash.

    The ledger is a table, so it outlives restarts and no state grows in the query.
    """
    def batch(df: DataFrame, _: int) -> None:
        append_rows(transform(df), headers, target, ledger)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(debut, group, n) per time window; rows later than ``late`` are left out of a stream."""
    counted = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), group).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("debut"), group, "n")


def run_windowed_counts(spark: SparkSession, path: str, schema: str, target: str, checkpoint: str, **how: str) -> DataFrame:
    """Run :func:`windowed_counts` over the files there are and read the result."""
    query = (
        windowed_counts(spark.readStream.schema(schema).parquet(path), **how)
        .writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)
