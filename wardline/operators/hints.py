"""Routing, cost and cache hints; nearest neighbours; grounding of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import fixed as X

def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def complexity(text: Column) -> Column:
    """struct<level, reasons>: LOW, MEDIUM or HIGH by word bands, lifted by reasoning markers, code and many questions."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    lines = F.size(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""))
    band = F.when(n < X.LOW_WORDS, 0).when(n < X.MEDIUM_WORDS, 1).otherwise(2)
    reasoning, code = any_of(F.lower(text), X.REASONING), any_of(text, X.CODE)
    long_code = code & (lines > X.CODE_LINES)
    lifted = F.when(reasoning | long_code, 2).when(code, F.greatest(band, F.lit(1))).otherwise(band)
    many = (F.length(text) - F.length(F.replace(text, F.lit("?"))) >= X.QUESTIONS) & (lifted < 2)
    level = F.when(many, F.greatest(lifted, F.lit(1))).otherwise(lifted)
    names = lambda *v: F.array(*map(F.lit, v))
    reasons = F.array(F.get(names("short_prompt", "moderate_length", "long_prompt"), band), F.when(reasoning, "reasoning_markers"), F.when(long_code, "large_code_block").when(code, "code_present"), F.when(many, "multi_part_question"))
    return F.struct(F.get(names("LOW", "MEDIUM", "HIGH"), level).alias("level"), F.array_compact(reasons).alias("reasons"))


def complexity_by_tokens(texts: Column) -> Column:
    """low, medium or high of a request's user messages (an array): characters over four, code fences, reasoning and step words."""
    total = F.aggregate(texts, F.lit(0), lambda s, t: s + F.length(t)) / 4
    code = F.exists(texts, lambda t: F.contains(t, F.lit("```")))
    reasoning = F.exists(texts, lambda t: any_of(F.lower(t), X.GATEWAY_REASONING))
    steps = F.exists(texts, lambda t: F.size(F.filter(F.array(*map(F.lit, X.GATEWAY_STEPS)), lambda m: F.contains(F.lower(t), m))) >= 2)
    return F.when((total > 1000) | code | (reasoning & steps), "high").when((total > 250) | reasoning | steps, "medium").otherwise("low")


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def longest_prefix(rows: DataFrame, name: str, prices: DataFrame) -> DataFrame:
    """Adds the price row of the exact name, else of the longest name it starts with (a fixed price list is broadcast)."""
    hit = rows.select(name).distinct().join(F.broadcast(prices.select(F.col("model").alias("__m"), "price_in", "price_out")), F.startswith(F.col(name), F.col("__m")))
    best = hit.groupBy(name).agg(F.max_by(F.struct(F.col("__m").alias("matched"), "price_in", "price_out"), F.length("__m")).alias("p"))
    return rows.join(best, name, "left").select(*rows.columns, "p.*")


#: fixed value: a sentence ends where white space follows a stop and a capital, digit, quote or bracket comes next
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"


def sentences(text: Column) -> Column:
    """All sentences of a reference, none of them empty."""
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE), F.trim), lambda p: p != "")


def claims(text: Column, least: int = 4, most: int = 40) -> Column:
    """Sentences that can be checked: no questions, at least four words, at most forty of them."""
    fit = F.filter(sentences(text), lambda p: ~F.endswith(p, F.lit("?")) & (F.size(F.split(p, r"\s+")) >= least))
    return F.slice(fit, 1, most)


def verdicts(scores: DataFrame) -> DataFrame:
    """Per request: how many claims the evidence supports or contradicts, the share supported, and its band.

    scores: request_id, claim_id, ref_id, entailment, contradiction. The best evidence of a claim has the greatest entailment.
    """
    best = scores.groupBy("request_id", "claim_id").agg(F.max(F.struct("entailment", "contradiction")).alias("b"))
    e, c = F.col("b.entailment"), F.col("b.contradiction")
    judged = best.select("request_id", F.when((e >= 0.5) & (e >= c), "SUPPORTED").when((c >= 0.5) & (c > e), "CONTRADICTED").otherwise("UNSUPPORTED").alias("v"))
    n = judged.groupBy("request_id").agg(F.count("*").alias("n_claims"), F.count(F.when(F.col("v") == "SUPPORTED", 1)).alias("supported"), F.count(F.when(F.col("v") == "CONTRADICTED", 1)).alias("contradicted"))
    score = F.round(F.col("supported") / F.col("n_claims"), 4)
    return n.select("*", score.alias("score"), F.when(score >= 0.75, "grounded").when(score >= 0.5, "partial").otherwise("ungrounded").alias("status"))


def rehydrate(text: Column, vault: Column) -> Column:
    """The text with the vault's placeholders replaced by their values."""
    return F.aggregate(F.map_entries(vault), text, lambda t, e: F.replace(t, e["key"], e["value"]))
