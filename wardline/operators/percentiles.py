"""Exact nearest-rank percentiles without a task that holds a group's values.

If every group is small enough for one task, the built-in does it. Else the values of large groups are counted into ranges, which
combine before the shuffle; only the range that holds the rank is looked into further, with new ranges between its least and
greatest value, until one value is left or so few that they can be sorted. Every round splits the range it looks into,
so the search ends whatever the values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 1024
#: values of a group that one task may sort
SORTED = 1_000_000
#: groups that can be larger than the limit, so that their ranges can be broadcast: the limit grows with the table
MOST_LARGE = 20_000


def _rank(n: Column, p: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * p)).cast("long")


def _range_of(v: Column, low: Column, high: Column) -> Column:
    """The number of a value's range: never smaller for a larger value, 0 for the least and RANGES - 1 for the greatest."""
    wide = (high - low) == float("inf")
    part = F.when(wide, (v / 4 - low / 4) / (high / 4 - low / 4)).otherwise((v - low) / (high - low))
    return F.least(F.lit(RANGES - 1), F.floor(part * RANGES)).cast("int")


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], sorted_values: int = SORTED) -> DataFrame:
    """(by, name, ...): for each name the nearest-rank percentile (column, p) of the group's non-null values, as a double.

    It is the smallest value with at least p of the values at or below it. Null and NaN do not count; a group of none has
    null; a null key is a group; without keys the table is one group (no rows: one row of nulls).
    """
    spark = rows.sparkSession
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    value = lambda c: F.struct(F.lit(columns.index(c)).alias("c"), F.col(c).cast("double").alias("v"))
    group = F.struct(*[F.col(k).alias(k) for k in by]) if by else F.struct(F.lit(0).alias("all"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    limit = max(sorted_values, -(-(whole["n"] or 0) // MOST_LARGE))
    if (whole["most"] or 0) <= limit:
        told = lambda c, p: F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY CASE WHEN NOT isnan(CAST(`{c}` AS DOUBLE)) THEN CAST(`{c}` AS DOUBLE) + 0D END)")
        return rows.groupBy(*by).agg(*[told(c, p).alias(name) for name, (c, p) in wanted.items()])
    groups = rows.select(group.alias("g")).distinct() if by else spark.range(1).select(group.alias("g"))
    long = rows.select(group.alias("g"), F.explode(F.array(*map(value, columns))).alias("x")).select("g", "x.c", (F.col("x.v") + 0.0).alias("v")).where("v is not null and not isnan(v)")
    sizes = long.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    asked = spark.createDataFrame([(name, columns.index(c), float(p)) for name, (c, p) in wanted.items()], "name string, c int, p double")
    large = sizes.where(F.col("n") > limit)
    values = _refined(long, large, asked, limit).union(_sorted(long.join(F.broadcast(large.select("g", "c")), ["g", "c"], "left_anti"), asked))
    wide = groups.join(values, "g", "left").groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted])
    return wide.select(*[F.col(f"g.{k}") for k in by], *wanted)


def _sorted(long: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, name, v) of groups that one task may sort; values are counted first, and the sort can spill."""
    counts = long.groupBy("g", "c", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "c").orderBy("v"))
    placed = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("g", "c")))
    rank = _rank(F.col("all"), F.col("p"))
    return placed.join(F.broadcast(asked), "c").where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select("g", "name", "v")


def _refined(long: DataFrame, large: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(g, name, v) of large groups. The state is a row for each of their percentiles: a range and the rank within it."""
    spark = long.sparkSession
    state = large.join(F.broadcast(asked), "c").select("g", "c", "name", "low", "high", "n", _rank(F.col("n"), F.col("p")).alias("rank"))
    schema = state.schema
    open_ = state.collect()  # as many as there are large groups, which MOST_LARGE bounds, and percentiles
    closed = []
    last = []
    while open_:
        closed += [(r["g"], r["name"], r["low"]) for r in open_ if r["low"] == r["high"]]
        last += [r for r in open_ if r["low"] != r["high"] and r["n"] <= limit]
        open_ = [r for r in open_ if r["low"] != r["high"] and r["n"] > limit]
        if not open_:
            break
        at = F.broadcast(spark.createDataFrame(open_, schema).withColumnsRenamed({"n": "within"}))
        inside = long.join(at, ["g", "c"]).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        ranges = inside.groupBy("g", "c", "name", "rank", _range_of(F.col("v"), F.col("low"), F.col("high")).alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("g", "c", "name").orderBy("k"))
        hit = ranges.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        open_ = hit.select("g", "c", "name", "low", "high", "n", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect()
    kind = large.schema["g"].dataType.simpleString()
    found = spark.createDataFrame(closed, f"g {kind}, name string, v double")
    if last:
        at = F.broadcast(spark.createDataFrame(last, schema).withColumnsRenamed({"n": "within"}))
        inside = long.join(at, ["g", "c"]).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).groupBy("g", "name", "rank", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("v"))
        found = found.union(inside.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("g", "name", "v"))
    return found
