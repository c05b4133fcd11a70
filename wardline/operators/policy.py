"""Policy: rule resolution, the fold of findings into a decision, differences between rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"allow": 0, "warn": 1, "sanitize": 2, "block": 3}


def ranked(action: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), action)


def unranked(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(a) for a in RANK]), rank)


def resolve(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The most specific rule of each key: the key itself, else with its last segments stripped, else none.

    keys: key; rules: key, action (a rule table of fixed, small size is broadcast).
    """
    parts = F.split("key", r"\.")
    depths = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    tried = keys.select("key", F.explode(depths).alias("depth")).withColumn("try", F.array_join(F.slice(F.split("key", r"\."), F.lit(1), F.col("depth")), "."))
    hit = tried.join(F.broadcast(rules.select(F.col("key").alias("try"), "action", "priority", "appealable")), "try")
    best = hit.groupBy("key").agg(F.max_by(F.struct(F.col("try").alias("rule"), "action", "priority", "appealable"), "depth").alias("r"))
    return keys.distinct().join(best, "key", "left").select("key", "r.*")


def decide(findings: DataFrame, request: str) -> DataFrame:
    """One decision per request: the strongest action, the reason of greatest priority (first found wins ties), rules in order.

    findings: request, ordinal, rule, action, priority.
    """
    out = findings.groupBy(request).agg(
        F.max(ranked(F.col("action"))).alias("rank"),
        F.max_by("rule", F.when(F.col("action") == "block", F.struct("priority", -F.col("ordinal")))).alias("block_rule"),
        F.count(F.when(F.col("action") == "sanitize", 1)).alias("n_sanitize"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "rule"))), lambda x: x["rule"])).alias("rules_fired"),
    )
    return out.select(request, unranked(F.col("rank")).alias("decision"), "block_rule", "n_sanitize", "rules_fired")


def lift(findings: DataFrame, request: str, overridden: str) -> DataFrame:
    """Findings with appealable blocks of overridden requests lowered to sanitize."""
    lifted = F.col(overridden) & (F.col("action") == "block") & F.col("appealable")
    return findings.withColumn("action", F.when(lifted, "sanitize").otherwise(F.col("action")))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules added, removed or changed between two rule tables (key, action)."""
    a, b = old.select("key", F.col("action").alias("before")), new.select("key", F.col("action").alias("after"))
    joined = a.join(b, "key", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.withColumn("change", change).where("change is not null")


def egress(rows: DataFrame, harm_at: float, bias_at: float, pass_at: float, annotate_at: float) -> DataFrame:
    """PASS, ANNOTATE or REPLACE from harm, bias and grounding scores; a null grounding score decides nothing."""
    harm = F.when(F.col("harm") >= harm_at, 2).otherwise(0)
    bias = F.when(F.col("bias") >= bias_at, 1).otherwise(0)
    ground = F.when(F.col("grounding").isNull() | (F.col("grounding") >= pass_at), 0).when(F.col("grounding") >= annotate_at, 1).otherwise(2)
    return rows.withColumn("egress_action", F.element_at(F.array(F.lit("PASS"), F.lit("ANNOTATE"), F.lit("REPLACE")), F.greatest(harm, bias, ground) + 1))


def flags(rules: DataFrame) -> DataFrame:
    """Per profile: which families of rules do anything but allow, and whether personal data can block."""
    on = lambda prefix: F.bool_or(F.startswith("key", F.lit(prefix)) & (F.col("action") != "allow"))
    return rules.groupBy("profile").agg(on("pii.").alias("pii"), on("secret.").alias("secret"), on("injection").alias("injection"), F.bool_or(F.startswith("key", F.lit("pii.")) & (F.col("action") == "block")).alias("blocks_pii"))
