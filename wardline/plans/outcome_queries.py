"""Queries over answers and their outcomes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import outcome as O
from wardline.plans.inspect_queries import _rules
from wardline.plans.registry import query
from wardline.plans.stream_queries import _SCORES, _scores
from wardline.plans.text_queries import RULES_SQL
from wardline.operators import metrics as M
from wardline.sources import bridge as B

@query("should_rehydrate", "SELECT event_id, event_type = 'signup' AND event_id % 3 <> 0 AS may FROM events")
def should_rehydrate(spark, sf_dir):
    n = F.col("event_id")
    decision = F.when(F.col("event_type") == "signup", "sanitize").otherwise("allow")
    holders = F.array(F.lit("<EMAIL_1>"), F.when(n % 3 == 0, "<SECRET_1>").otherwise("<PHONE_1>"))
    return B.table(spark, sf_dir, "events").select("event_id", O.may_rehydrate(decision, holders).alias("may"))


@query("grounding_outcome", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unverified' WHEN event_id % 3 = 0 THEN 'fallback' WHEN event_id % 3 = 1 THEN 'annotated' ELSE 'passed' END AS outcome FROM events")
def grounding_outcome(spark, sf_dir):
    n = F.col("event_id")
    action = F.when(n % 3 == 0, "REPLACE").when(n % 3 == 1, "ANNOTATE").otherwise("PASS")
    return B.table(spark, sf_dir, "events").select("event_id", O.grounding_outcome(action, F.when(n % 5 > 0, F.lit(True))).alias("outcome"))


@query("lexical_overlap", "WITH w AS (SELECT a.item_id, list_filter(regexp_split_to_array(lower(a.text), '[^a-z]+'), lambda x: length(x) > 4) AS words, lower(b.text) AS ref FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id // 2) SELECT item_id, round(least(1.0, 0.35 + 0.6 * coalesce(len(list_filter(words, lambda x: contains(ref, x))) / nullif(len(words), 0), 0)), 2) AS score FROM w")
def lexical_overlap(spark, sf_dir):
    b = B.table(spark, sf_dir, "benchmark")
    ref = b.select(F.col("item_id").alias("half"), F.col("text").alias("ref"))
    return b.join(ref, F.floor(F.col("item_id") / 2) == F.col("half")).select("item_id", O.lexical_overlap(F.col("text"), F.col("ref")).alias("score"))


_KEYS_SQL = "k AS (SELECT ['pii.K', 'secret.K', 'injection.K', 'unknown.x'][p_partkey % 4 + 1] || p_partkey AS key FROM part)"


@query("is_appealable", f"WITH {RULES_SQL}, {_KEYS_SQL} SELECT k.key, coalesce(b.appealable, false) AS appealable FROM k LEFT JOIN rules b ON b.profile = 'default' AND b.key = split_part(k.key, '.', 1)")
def is_appealable(spark, sf_dir):
    k = F.col("p_partkey")
    family = F.get(F.array(*map(F.lit, ("pii.K", "secret.K", "injection.K", "unknown.x"))), (k % 4).cast("int"))
    return O.appealable(B.table(spark, sf_dir, "part").select(F.concat(family, k).alias("key")), _rules(spark))


@query("fairness_report", f"WITH {_SCORES}, docs AS (SELECT lang AS grp, toxic = 1 AS truth, regexp_matches(lower(text), 'idiot|scum') AS hit FROM documents JOIN labels USING (doc_id)), a AS (SELECT grp, round(count(*) FILTER (WHERE truth AND hit) / nullif(count(*) FILTER (WHERE truth), 0), 4) AS r FROM docs GROUP BY grp), b AS (SELECT grp, round(count(*) FILTER (WHERE truth AND hit) / nullif(count(*) FILTER (WHERE truth), 0), 4) AS r FROM scores GROUP BY grp) SELECT grp, a.r AS recall_before, b.r AS recall_after, round(b.r - a.r, 4) AS delta FROM a FULL JOIN b USING (grp)")
def fairness_report(spark, sf_dir):
    docs, labels = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels")
    old = docs.join(labels, "doc_id").select(F.col("lang").alias("grp"), (F.col("toxic") == 1).alias("truth"), F.lower("text").rlike("idiot|scum").alias("hit"))
    recall = lambda df: df.groupBy("grp").agg(F.round(F.try_divide(M.count_if(F.col("truth") & F.col("hit")), M.count_if(F.col("truth"))), 4).alias("recall"))
    return O.group_report(recall(old), recall(_scores(spark, sf_dir)))
