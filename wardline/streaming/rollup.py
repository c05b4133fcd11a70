"""A dashboard kept up to date: counts, sums and latency histograms by grain of time, mergeable, read without the rows they came from.

A cell is one number of one grain: a counter, or how many requests took so many milliseconds. Cells add up, so batches may come in
any order and rows late; the commit log takes each batch once. A grain's histogram has a cell for each whole millisecond that
occurs, whatever the number of rows; ranks in it give the same percentile, in milliseconds, as the rows would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.operators import audit as A
from wardline.sources.commitlog import Table

GRAIN = 3600
COUNTERS = ("requests", "allowed", "sanitized", "blocked", "cache_hits", "tokens")
HOW = {"grain": A.OVERWRITE, "kind": A.OVERWRITE, "n": A.ADD}


def cells(rows: DataFrame, grain: int = GRAIN) -> DataFrame:
    """(cell, grain, kind, n) of audit rows; rows without a time are in no grain. Combined before the shuffle."""
    action = F.col("policy_action")
    one = lambda c: F.when(c, 1).cast("long")
    numbers: dict[str, Column] = {"requests": F.lit(1).cast("long"), "allowed": one(action.isin("ALLOW", "WARN")), "sanitized": one(action == "SANITIZE"), "blocked": one(action == "BLOCK"), "cache_hits": one(F.col("cache_hit")), "tokens": F.col("total_tokens").cast("long")}
    pairs = [F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in numbers.items()]
    ms = F.struct(F.concat(F.lit("ms="), F.round("latency_total_ms").cast("long").cast("string")).alias("kind"), F.lit(1).cast("long").alias("n"))
    at = F.floor(F.unix_timestamp("ts") / grain) * grain
    long = rows.where("ts is not null").select(at.alias("grain"), F.explode(F.array(*pairs, ms)).alias("x")).where("x.n is not null and x.kind is not null")
    sums = long.groupBy("grain", "x.kind").agg(F.sum("x.n").alias("n"))
    return sums.select(F.concat_ws("|", F.col("grain").cast("string"), "kind").alias("cell"), "grain", "kind", "n")


def table(spark: SparkSession, path: str, buckets: int = 16) -> Table:
    return Table(spark, path, "cell", buckets)


def update(path: str, stream: str = "audit", grain: int = GRAIN, buckets: int = 16):
    """A foreachBatch function that adds a batch of audit rows; a batch that comes again changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        table(batch.sparkSession, path, buckets).merge(cells(batch, grain), HOW, stream, number)

    return add


def series(spark: SparkSession, path: str, begin: str, end: str, buckets: int, grain: int = GRAIN) -> DataFrame:
    """As ``metrics.series``, from the cells; the bounds of its buckets must be bounds of grains."""
    t0, t1 = (int(spark.range(1).select(F.unix_timestamp(F.lit(x).cast("timestamp"))).first()[0]) for x in (begin, end))
    if t0 % grain or (t1 - t0) % (buckets * grain):
        raise ValueError(f"buckets must begin and end at multiples of {grain} seconds")
    rows = table(spark, path).read().where(F.col("grain").between(t0, t1 - 1))
    rows = rows.select(F.expr(f"(grain - {t0}) div {(t1 - t0) // buckets}").alias("bucket"), "kind", "n")
    counters = rows.where(F.col("kind").isin(*COUNTERS)).groupBy("bucket").pivot("kind", list(COUNTERS)).agg(F.sum("n"))
    timed = rows.where("kind like 'ms=%'").groupBy("bucket", F.substring("kind", 4, 20).cast("long").alias("ms")).agg(F.sum("n").alias("n"))
    every = Window.partitionBy("bucket")
    ranked = timed.withColumn("upto", F.sum("n").over(every.orderBy("ms"))).withColumn("whole", F.sum("n").over(every))
    rank = F.greatest(F.lit(1), F.ceil(F.col("whole") * F.lit(0.95)))
    p95 = ranked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select("bucket", F.col("ms").alias("p95_ms"))
    all_buckets = spark.range(buckets).select(F.col("id").alias("bucket"))
    out = all_buckets.join(F.broadcast(counters), "bucket", "left").join(F.broadcast(p95), "bucket", "left")
    return out.na.fill(0, list(COUNTERS)).select("bucket", *COUNTERS, "p95_ms")
