"""How evenly engines find names: recall by group, for names that a list covers and for those held out, gaps and how far they close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(texts: DataFrame, found: DataFrame, key: str, engine: str) -> DataFrame:
    """texts (key, grp, name, covered) with hit: whether the engine found (key, start, value) a name that holds the text's own; one shuffle by key.

    Names are found at most a few times a text; rows of found without a text do not count.
    """
    values = found.groupBy(key).agg(F.collect_set("value").alias("values"))
    hit = F.coalesce(F.exists("values", lambda v: F.contains(v, F.col("name"))), F.lit(False))
    return texts.join(values, key, "left").select(F.lit(engine).alias("engine"), "grp", "covered", hit.alias("hit"))


def tallies(scores: DataFrame) -> DataFrame:
    """Per engine and group: n, hits, recall, and the recall of covered and of held-out names (null without any), four decimals."""
    hit = lambda c: F.count(F.when(F.col("hit") & c, 1))
    n = lambda c: F.count(F.when(c, 1))
    covered = F.coalesce(F.col("covered"), F.lit(False))
    rate = lambda c, name: F.round(F.try_divide(hit(c), n(c)), 4).alias(name)
    return scores.groupBy("engine", "grp").agg(F.count("*").alias("n"), hit(F.lit(True)).alias("hits"), rate(F.lit(True), "recall"), rate(covered, "covered_recall"), rate(~covered, "held_out_recall"))


def gaps(tallied: DataFrame, baseline: str) -> DataFrame:
    """Per engine: best and worst recall, the gap between them, the worst group (the first by name at a tie), and how much of the baseline's gap is closed."""
    per = tallied.groupBy("engine").agg(F.max("recall").alias("best"), F.min("recall").alias("worst"), F.min(F.struct("recall", "grp"))["grp"].alias("worst_group"))
    per = per.withColumn("gap", F.round(F.col("best") - F.col("worst"), 4))
    base = per.where(F.col("engine") == baseline).select(F.col("gap").alias("__base"))  # one row
    return per.crossJoin(F.broadcast(base)).select("engine", "best", "worst", "worst_group", "gap", F.round(F.col("__base") - F.col("gap"), 4).alias("gap_closed"))
