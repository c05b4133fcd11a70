"""Streaming jobs: merging audit halves as they come, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.commitlog import Table
from wardline.streaming import limits as L


def merge_batch(path: str, key: str, how: dict[str, str], stream: str = "audit", buckets: int = 64):
    """A foreachBatch function that merges each batch into the table of a folder.

    The batch's number is part of the commit, so a batch that is run again, after a restart too, changes nothing.
    Streams that write to one table need names of their own.
    """

    def merge(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, path, key, buckets).merge(batch, how, stream, number)

    return merge


def current(spark: SparkSession, path: str, key: str = "request_id") -> DataFrame:
    """The newest version of a merged table."""
    return Table(spark, path, key).read()


def retention(spark: SparkSession, path: str, cutoff: str, key: str = "request_id", column: str = "ts") -> int:
    """Rows older than the cutoff are gone from the newest version on; how many went."""
    return Table(spark, path, key).retain(cutoff, column)


def retention_batch(path: str, days: int, key: str = "request_id", column: str = "ts", keep: int = 2, grace_seconds: float = 3600.0):
    """A foreachBatch function of a schedule: each tick (a batch of a rate stream, say) removes what is older than so many days before the tick's newest time, and files no version needs."""

    def tick(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max("timestamp")).first()[0]
        if now is None:
            return
        table = Table(batch.sparkSession, path, key)
        cutoff = batch.sparkSession.range(1).select((F.lit(now) - F.make_dt_interval(F.lit(days))).cast("string")).first()[0]
        table.retain(cutoff, column)
        table.vacuum(keep, grace_seconds)

    return tick


def windowed_counts(events: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Tumbling counts over a stream; events later than the watermark are left out."""
    return L.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width, *by)
