"""Refresh by Structured Streaming: keyed upserts of a stream, and a periodic run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork.cluster import delete
from presswork.operators.ranking import first_n

#: Seconds between two refreshes.
PERIOD_SECONDS = 600


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, tie: str, once: bool = True) -> StreamingQuery:
    """Keep the latest row of each key of a stream in a folder of versions.

    Each batch writes a whole new version, named by its number, from the one
    before: a batch that runs again writes the same version again. The version
    before that is deleted then, so two are kept. ``once`` takes what is there and ends; else a batch starts every ``PERIOD_SECONDS``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number > 0:
            new = new.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        first_n(new, 1, [key], F.desc(time), F.desc(tie)).write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            delete(spark, f"{path}/version={number - 2}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{PERIOD_SECONDS} seconds")).start()


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={number}")


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream by kind in tumbling windows; events later than ``late`` are dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def refresh_periodically(spark: SparkSession, refresh: Callable[[], None], checkpoint: str, once: bool = False, period: int = PERIOD_SECONDS) -> StreamingQuery | None:
    """Run ``refresh`` every ``period`` seconds, or a single time.

    A rate stream is only the clock; ``refresh`` sees to it that a source which
    fails does not stop the others.
    """
    if once:
        refresh()
        return None
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda batch, number: refresh()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{period} seconds").start()
