"""Exact percentiles by refined ranges: equal to sorting, however the values lie."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import percentiles as P

WANTED = {"p50": ("a", 0.5), "p95": ("a", 0.95), "p0": ("a", 0.0), "p100": ("a", 1.0), "b99": ("b", 0.99)}


def plain(rows):
    groups = {}
    for g, a, b in rows:
        groups.setdefault(g, ([], []))
        for k, v in enumerate((a, b)):
            if v is not None and not math.isnan(v):
                groups[g][k].append(v)
    at = lambda vs, p: sorted(vs)[max(1, math.ceil(len(vs) * p)) - 1] if vs else None
    return {g: tuple(at(vs["ab".index(c)], p) for c, p in WANTED.values()) for g, vs in groups.items()}


def data(seed):
    rng = random.Random(seed)
    kinds = {
        "even": lambda: rng.uniform(-5, 5), "skewed": lambda: math.exp(rng.gauss(0, 30)), "few": lambda: float(rng.randrange(4)), "same": lambda: 7.25,
        "huge": lambda: rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300]), "ints": lambda: float(rng.randrange(10**6)), None: lambda: rng.random(), "none": lambda: None,
    }
    rows = [(g, f(), None if rng.random() < 0.3 else rng.random()) for g, f in kinds.items() for _ in range(700 if g != "even" else 3000)]
    return rows + [("odd", float("nan"), -0.0), ("odd", None, 0.0)]


@pytest.mark.parametrize("limit", [P.SORTED, 100, 5])
def test_percentiles_by_group(spark, limit):
    rows = data(limit)
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    got = {r["g"]: tuple(r[n] for n in WANTED) for r in P.percentiles(df, ["g"], WANTED, limit).collect()}
    assert got == plain(rows)


def test_equal_to_the_built_in(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("t"), (F.col("id") % 2).alias("u"), (F.pmod(F.xxhash64("id"), F.lit(99_991)) / 7).alias("a"))
    got = P.percentiles(df, ["t", "u"], {f"p{k}": ("a", k / 100) for k in (1, 50, 95, 99)}, 200)
    want = df.groupBy("t", "u").agg(*[F.expr(f"percentile_disc({k / 100}) WITHIN GROUP (ORDER BY a)").alias(f"p{k}") for k in (1, 50, 95, 99)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_group_and_no_rows(spark):
    df = spark.range(1001).select(F.col("id").alias("a"))
    assert P.percentiles(df, [], {"m": ("a", 0.5)}, 10).collect()[0]["m"] == 500.0
    assert [tuple(r) for r in P.percentiles(df.limit(0), [], {"m": ("a", 0.5)}).collect()] == [(None,)]
    assert P.percentiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], {"m": ("a", 0.5)}).collect() == []


def test_no_row_of_a_large_group_is_sorted(spark):
    """In the refining rounds a task gets a count for each range, never the values."""
    df = spark.range(20_000).select(F.lit("x").alias("g"), F.rand(3).alias("a"))
    long = df.select(F.struct("g").alias("g"), F.lit(0).alias("c"), F.col("a").alias("v"))
    sizes = long.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = P._refined(long, sizes, spark.createDataFrame([("m", 0, 0.5)], "name string, c int, p double"), 40)
    assert "Window" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1
    values = sorted(r["a"] for r in df.collect())
    assert found.first()["v"] == values[9999]
