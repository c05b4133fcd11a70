"""What becomes of an answer: rehydration, grounding outcome, composition of egress checks, scrubbing of secret shapes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed as X
from wardline.operators import detect as D
from wardline.operators import hints as H
from wardline.operators import policy as P
from wardline.operators import spans as S

MASK = "[REDACTED]"
_MASK = MASK.replace("[", r"\[").replace("]", r"\]")


def scrub_shapes(text: Column) -> Column:
    """Without what has the shape of a credential, whatever else found it."""
    for shape in X.LEAVING_SHAPES:
        text = F.regexp_replace(text, shape, _MASK)
    return text


def client_safe(text: Column, spans: Column) -> Column:
    """Secret spans (start, end; those that do not fit are passed over) replaced, then the shapes; spans are sorted and disjoint."""
    fit = F.transform(F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["end"] > s["start"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(MASK).alias("placeholder")))
    return scrub_shapes(S.splice(text, fit))


def scrub_log(text: Column) -> Column:
    """A log line without what nine patterns know as a credential."""
    for pattern, replacement in X.LOG_SCRUB:
        text = F.regexp_replace(text, pattern, replacement.replace("[", r"\[").replace("]", r"\]") if "$" not in replacement else replacement)
    return text


def safe_headers(headers: Column) -> Column:
    """A map of headers in which those that bear credentials hold none."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*X.HEADER_DENYLIST), F.lit(MASK)).otherwise(v))


def leaks(text: Column, values: Column) -> Column:
    """Whether any value that was to be taken out is still there; a request of which this is true must not be sent."""
    return F.coalesce(F.exists(values, lambda v: (F.length(v) > 0) & F.contains(text, v)), F.lit(False))


def may_rehydrate(decision: Column, placeholders: Column) -> Column:
    """Only sanitised answers, and never one that holds a credential's placeholder."""
    return (decision == "sanitize") & ~F.exists(placeholders, lambda p: F.startswith(p, F.lit("<SECRET_")))


def grounding_outcome(action: Column, verified: Column) -> Column:
    """No verdict means unverified, never passed; a replacement falls back."""
    return F.when(verified.isNull(), "unverified").when(action == "REPLACE", "fallback").when(action == "ANNOTATE", "annotated").otherwise("passed")


def lexical_overlap(answer: Column, reference: Column) -> Column:
    """Share of the answer's words of over four letters that the reference holds, as 0.35 + 0.6 * share, two decimals."""
    words = F.filter(F.split(F.lower(answer), "[^a-z]+"), lambda w: F.length(w) > 4)
    found = F.filter(words, lambda w: F.contains(F.lower(reference), w))
    return F.round(F.least(F.lit(1.0), F.lit(0.35) + 0.6 * F.coalesce(F.try_divide(F.size(found), F.size(words)), F.lit(0.0))), 2)


def egress_results(answers: DataFrame, text: str, key: str, grounding: DataFrame, harm_at: float = X.HARM_AT, bias_at: float = X.BIAS_AT, pass_at: float = 0.75, annotate_at: float = 0.5, checks: tuple[str, ...] = ("harm", "bias", "grounding")) -> DataFrame:
    """Harm and bias screens and grounding scores (key, score) composed into one action per answer, by the checks asked for."""
    harm, bias = (D.screen(answers, text, [key], c, X.GROUPS).select(key, F.col("score").alias(n)) for c, n in ((X.HARM_SCREEN, "harm"), (X.BIAS_SCREEN, "bias")))
    rows = answers.select(key).join(harm, key, "left").join(bias, key, "left").join(grounding.select(key, F.col("score").alias("grounding")), key, "left").na.fill(0.0, ["harm", "bias"])
    for name, none in (("harm", F.lit(0.0)), ("bias", F.lit(0.0)), ("grounding", F.lit(None).cast("double"))):
        if name not in checks:
            rows = rows.withColumn(name, none)
    return P.egress(rows, harm_at, bias_at, pass_at, annotate_at)


def final_answer(action: Column, streamed: Column, fallback: Column, vault: Column, decision: Column) -> Column:
    """What the reader gets: the fallback where the answer is replaced, else the answer, with the vault's values where that is allowed."""
    own = F.when(may_rehydrate(decision, F.map_keys(vault)), H.rehydrate(streamed, vault)).otherwise(streamed)
    return F.when(action == "REPLACE", fallback).otherwise(own)


def appealable(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether a block under each key can be appealed; unknown keys cannot."""
    return P.resolve(keys, rules).select("key", F.coalesce("appealable", F.lit(False)).alias("appealable"))


def sarif_rows(results: DataFrame, tool: str) -> DataFrame:
    """One SARIF result object (JSON) for each of (path, line, rule_id, level): places and rules, never values."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").cast("int").alias("startLine")).alias("region")).alias("physicalLocation"))
    return results.select("path", "line", "rule_id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("rule_id").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def write_sarif(results: DataFrame, tool: str, path: str) -> None:
    """SARIF logs under a folder, one for each part of the results; no result passes through the driver, which reads the rule names only."""
    rules = [r["rule_id"] for r in results.select("rule_id").distinct().orderBy("rule_id").collect()]
    head = json.dumps({"tool": {"driver": {"name": tool, "rules": [{"id": i} for i in rules]}}})[:-1]

    def logs(batches):
        import pyarrow as pa

        found = [x for b in batches for x in b.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_pydict({"value": ['{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [' + head + ', "results": [' + ", ".join(found) + "]}]}"]})

    ordered = sarif_rows(results, tool).repartitionByRange("path", "line", "rule_id").sortWithinPartitions("path", "line", "rule_id")
    ordered.select("result").mapInArrow(logs, "value string").write.mode("overwrite").text(path)


def group_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Recall of each group before and after, with the change; groups of either side are kept."""
    a, b = before.select("grp", F.col("recall").alias("recall_before")), after.select("grp", F.col("recall").alias("recall_after"))
    return a.join(b, "grp", "full_outer").withColumn("delta", F.round(F.col("recall_after") - F.col("recall_before"), 4))
