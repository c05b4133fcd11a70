"""The rollup against the series of the rows themselves: shuffled, late and repeated batches, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import metrics as M
from wardline.sources import bridge as B
from wardline.streaming import rollup as R

RANGE = ("2024-01-01 00:00:00", "2024-02-05 00:00:00", 30)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("bucket", *R.COUNTERS, "p95_ms").collect())


def test_rollup_equals_the_series(spark, sf_dir, tmp_path):
    path = str(tmp_path / "rollup")
    audit = B.audit(spark, sf_dir).select("request_id", "ts", "policy_action", "cache_hit", "total_tokens", "latency_total_ms")
    odd = audit.limit(3).select((-F.col("request_id") - 1).alias("request_id"), F.when(F.col("request_id") % 2 == 0, F.col("ts")).alias("ts"), F.lit(None).cast("string").alias("policy_action"), F.lit(None).cast("boolean").alias("cache_hit"), F.lit(None).cast("long").alias("total_tokens"), F.lit(None).cast("double").alias("latency_total_ms"))
    audit = audit.unionByName(odd).withColumn("batch", F.pmod(F.xxhash64("request_id"), F.lit(4)))
    order = [0, 1, 2, 3, 1, 3, 0]
    random.Random(2).shuffle(order)
    for b in order:
        seen = {k: n for n, k in enumerate(dict.fromkeys(order))}
        R.update(path, buckets=3)(audit.where(F.col("batch") == b).drop("batch"), seen[b])
        assert R.table(spark, path).head().batches["audit"] >= seen[b]
    assert rows_of(R.series(spark, path, *RANGE)) == rows_of(M.series(audit, *RANGE))
    cells = R.table(spark, path).read()
    assert cells.count() == cells.select("cell").distinct().count() and set(cells.columns) == {"cell", "grain", "kind", "n"}


def test_two_streams_and_bounds(spark, sf_dir, tmp_path):
    path = str(tmp_path / "rollup")
    audit = B.audit(spark, sf_dir)
    for name, part in (("a", "request_id % 2 = 0"), ("b", "request_id % 2 = 1")):
        for _ in range(2):
            R.update(path, name, buckets=2)(audit.where(part), 0)
    assert rows_of(R.series(spark, path, *RANGE)) == rows_of(M.series(audit, *RANGE))
    with pytest.raises(ValueError):
        R.series(spark, path, "2024-01-01 00:30:00", "2024-02-05 00:00:00", 30)
    with pytest.raises(ValueError):
        R.series(spark, path, "2024-01-01 00:00:00", "2024-02-05 00:00:00", 31)
