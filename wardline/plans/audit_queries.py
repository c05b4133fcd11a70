"""Queries over audit rows and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import audit as A
from wardline.operators import metrics as M
from wardline.plans.registry import query
from wardline.session import work_folder
from wardline.sources import bridge as B
from wardline.sources import rules
from wardline.sources.commitlog import Table
from wardline.streaming import rollup as R

WEEK = 168
SINCE = "TIMESTAMP '2024-01-24 00:00:00'"
WITH = f"WITH {B.AUDIT_SQL}"
LATENCY = """round(quantile_disc(latency_total_ms, 0.5), 3) AS p50_ms, round(quantile_disc(latency_total_ms, 0.95), 3) AS p95_ms"""


def _week(spark, sf_dir):
    return M.window(B.audit(spark, sf_dir), B.AS_OF, WEEK)


@query("audit_window", f"{WITH} SELECT tenant_id, count(*) AS n FROM audit WHERE ts >= {SINCE} AND tenant_id = 't1' GROUP BY tenant_id")
def audit_window(spark, sf_dir):
    return M.window(B.audit(spark, sf_dir), B.AS_OF, WEEK, "t1").groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("audit_list_page", f"{WITH} SELECT request_id, policy_action, tenant_id FROM audit WHERE tenant_id = 't1' AND policy_action = 'BLOCK' ORDER BY ts DESC, request_id DESC LIMIT 20 OFFSET 40")
def audit_list_page(spark, sf_dir):
    rows = B.audit(spark, sf_dir).where("tenant_id = 't1' and policy_action = 'BLOCK'").select("request_id", "policy_action", "tenant_id", "ts")
    return A.page(rows, 40, 20).drop("ts")


@query("audit_query_filtered", f"{WITH} SELECT request_id, provider, policy_action FROM audit WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND provider = 'beta' AND NOT cache_hit AND (pii_count > 0 OR secret_count > 0 OR block_code = 'PROMPT_INJECTION_BLOCKED' OR egress_flagged)")
def audit_query_filtered(spark, sf_dir):
    rows = B.audit(spark, sf_dir).where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and provider = 'beta' and not cache_hit")
    return rows.where(A.has_detections()).select("request_id", "provider", "policy_action")


@query("audit_recent", f"{WITH} SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT * FROM audit ORDER BY ts DESC, request_id DESC LIMIT 50) ORDER BY ts, request_id")
def audit_recent(spark, sf_dir):
    return M.newest(B.audit(spark, sf_dir).select("request_id", "ts"), 50).orderBy("ts", "request_id").select("request_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "audit_entries",
    f"""{WITH} SELECT request_id, lower(policy_action) AS action, pii_count + secret_count AS scrubbed, CASE WHEN policy_action = 'BLOCK' THEN block_code END AS error_code,
    CASE WHEN policy_action = 'BLOCK' THEN 403 ELSE 200 END AS status,
    CAST(pii_count > 0 AS INT) + CAST(secret_count > 0 AS INT) + CAST(coalesce(block_code = 'PROMPT_INJECTION_BLOCKED', false) AS INT) + CAST(egress_flagged AS INT) AS n_triggers FROM audit""",
)
def audit_entries(spark, sf_dir):
    return A.entries(B.audit(spark, sf_dir))


@query("audit_point_lookup", f"{WITH} SELECT request_id, tenant_id, policy_action, model FROM audit WHERE request_id = 77")
def audit_point_lookup(spark, sf_dir):
    return B.audit(spark, sf_dir).where("request_id = 77").select("request_id", "tenant_id", "policy_action", "model")


@query("reviews_list", f"WITH {B.REVIEWS_SQL} SELECT id, status FROM reviews WHERE status = 'PENDING' AND tenant_id = 't2' ORDER BY created_at DESC, id LIMIT 25")
def reviews_list(spark, sf_dir):
    return B.reviews(spark, sf_dir).where("status = 'PENDING' and tenant_id = 't2'").orderBy(F.desc("created_at"), "id").limit(25).select("id", "status")


@query("reviews_pending", f"WITH {B.REVIEWS_SQL} SELECT count(*) AS pending FROM reviews WHERE status = 'PENDING'")
def reviews_pending(spark, sf_dir):
    return B.reviews(spark, sf_dir).where("status = 'PENDING'").agg(F.count("*").alias("pending"))


@query(
    "latency_percentiles",
    f"""{WITH} SELECT tenant_id, {LATENCY}, round(quantile_disc(latency_total_ms, 0.99), 3) AS p99_ms, round(avg(latency_total_ms), 3) AS mean_ms,
    round(quantile_disc(latency_inspect_ms, 0.5), 3) AS overhead_p50_ms, round(quantile_disc(latency_inspect_ms, 0.95), 3) AS overhead_p95_ms FROM audit GROUP BY tenant_id""",
)
def latency_percentiles(spark, sf_dir):
    return M.latency(B.audit(spark, sf_dir), "tenant_id")


@query(
    "metrics_overview",
    f"""{WITH} SELECT tenant_id, count(*) AS total_requests, count(*) FILTER (WHERE policy_action = 'BLOCK') AS blocked_requests, count(*) FILTER (WHERE policy_action = 'SANITIZE') AS sanitized_requests,
    {LATENCY}, round(avg(latency_total_ms), 3) AS mean_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
    FROM audit WHERE ts >= {SINCE} GROUP BY tenant_id""",
)
def metrics_overview(spark, sf_dir):
    return M.overview(_week(spark, sf_dir), "tenant_id")


@query(
    "metrics_security",
    f"""WITH {B.AUDIT_SQL}, {B.REVIEWS_SQL}, r AS (SELECT tenant_id, count(*) FILTER (WHERE status = 'PENDING') AS reviews_pending, count(*) FILTER (WHERE status = 'APPROVED') AS reviews_approved, count(*) FILTER (WHERE status = 'DENIED') AS reviews_denied FROM reviews GROUP BY tenant_id)
    SELECT tenant_id, CAST(sum(pii_count) AS BIGINT) AS pii_detections, CAST(sum(secret_count) AS BIGINT) AS secret_detections, count(*) FILTER (WHERE block_code = 'PROMPT_INJECTION_BLOCKED') AS injection_blocks,
    count(*) FILTER (WHERE block_code = 'CREDENTIAL_LEAK_PREVENTED') AS credential_blocks, count(*) FILTER (WHERE egress_flagged) AS egress_flags,
    any_value(coalesce(reviews_pending, 0)) AS reviews_pending, any_value(coalesce(reviews_approved, 0)) AS reviews_approved, any_value(coalesce(reviews_denied, 0)) AS reviews_denied
    FROM audit LEFT JOIN r USING (tenant_id) GROUP BY tenant_id""",
)
def metrics_security(spark, sf_dir):
    return M.security(B.audit(spark, sf_dir), B.reviews(spark, sf_dir), "tenant_id")


@query("top_rules", f"{WITH} SELECT rule_id, count(*) AS n_fired FROM (SELECT unnest(rules_fired) AS rule_id FROM audit) GROUP BY rule_id ORDER BY n_fired DESC, rule_id LIMIT 5")
def top_rules(spark, sf_dir):
    return M.top_rules(B.audit(spark, sf_dir), 5)


@query(
    "metrics_providers",
    f"""{WITH}, roles AS (SELECT provider AS name, 'served' AS role, latency_provider_ms AS lat, ts FROM audit WHERE provider IS NOT NULL
      UNION ALL SELECT failover_from, 'out', NULL, NULL FROM audit WHERE failover_used UNION ALL SELECT failover_to, 'in', NULL, NULL FROM audit WHERE failover_used)
    SELECT name AS provider, count(*) FILTER (WHERE role = 'served') AS requests, count(*) FILTER (WHERE role = 'out') AS failures, count(*) FILTER (WHERE role = 'in') AS failover_in,
    count(*) FILTER (WHERE role = 'out') AS failover_out, round(quantile_disc(lat, 0.5), 3) AS latency_p50_ms, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM roles GROUP BY name""",
)
def metrics_providers(spark, sf_dir):
    return M.providers(B.audit(spark, sf_dir))


@query(
    "metrics_sustainability",
    f"""{WITH}, s AS (SELECT tenant_id, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE NOT cache_hit AND provider IS NOT NULL) AS cache_misses,
      avg(total_tokens) FILTER (WHERE NOT cache_hit AND provider IS NOT NULL AND total_tokens > 0) AS m FROM audit GROUP BY tenant_id)
    SELECT tenant_id, cache_hits, cache_misses, round(cache_hits / (cache_hits + cache_misses), 4) AS cache_hit_rate, round(floor(m) * 0.3 / 1000 * cache_hits, 4) AS energy_avoided_wh,
    round(floor(m) * 0.3 / 1000 * cache_hits * 480 / 1000, 4) AS co2_avoided_g FROM s""",
)
def metrics_sustainability(spark, sf_dir):
    return M.sustainability(B.audit(spark, sf_dir), 0.3, 480, "tenant_id")


@query(
    "audit_report",
    f"""{WITH}, w AS (SELECT * FROM audit WHERE ts >= {SINCE}) SELECT 'oversight' AS section, 'requests' AS metric, count(*) AS value FROM w UNION ALL SELECT 'safety', 'blocked', count(*) FROM w WHERE policy_action = 'BLOCK'
    UNION ALL SELECT 'privacy', 'pii', CAST(sum(pii_count) AS BIGINT) FROM w UNION ALL SELECT 'privacy', 'secrets', CAST(sum(secret_count) AS BIGINT) FROM w UNION ALL SELECT 'wellbeing', 'hits', count(*) FROM w WHERE cache_hit
    UNION ALL SELECT 'accountability', 'versions', count(DISTINCT policy_version) FROM w UNION ALL SELECT 'robustness', 'failovers', count(*) FROM w WHERE failover_used
    UNION ALL SELECT 'transparency', 'action:' || policy_action, count(*) FROM w GROUP BY policy_action""",
)
def audit_report(spark, sf_dir):
    return M.report(_week(spark, sf_dir))


SERIES_SQL = f"""{WITH}, r AS (SELECT *, least(29, greatest(0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 30 // (epoch_us(TIMESTAMP '2024-02-05') - epoch_us(TIMESTAMP '2024-01-01')))) AS bucket
  FROM audit WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-05'),
  s AS (SELECT bucket, count(*) AS requests, count(*) FILTER (WHERE policy_action IN ('ALLOW', 'WARN')) AS allowed, count(*) FILTER (WHERE policy_action = 'SANITIZE') AS sanitized,
    count(*) FILTER (WHERE policy_action = 'BLOCK') AS blocked, count(*) FILTER (WHERE cache_hit) AS cache_hits, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(round(quantile_disc(latency_total_ms, 0.95)) AS BIGINT) AS p95_ms FROM r GROUP BY bucket),
  series AS (SELECT b.bucket, coalesce(requests, 0) AS requests, coalesce(allowed, 0) AS allowed, coalesce(sanitized, 0) AS sanitized, coalesce(blocked, 0) AS blocked, coalesce(cache_hits, 0) AS cache_hits, coalesce(tokens, 0) AS tokens, p95_ms
    FROM (SELECT unnest(range(30)) AS bucket) b LEFT JOIN s USING (bucket))"""


def _series(spark, sf_dir):
    return M.series(B.audit(spark, sf_dir), "2024-01-01 00:00:00", "2024-02-05 00:00:00", 30)


@query("dashboard_series", f"{SERIES_SQL} SELECT * FROM series")
def dashboard_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query("dashboard_rollup", f"{SERIES_SQL} SELECT * FROM series")
def dashboard_rollup(spark, sf_dir):
    """The same series from cells alone: three batches, the last of late rows, one of them twice."""
    path = work_folder(spark, "rollup")
    rows = B.audit(spark, sf_dir)
    for number, part in enumerate(("request_id % 3 = 1", "request_id % 3 = 0", "request_id % 3 = 0", "request_id % 3 = 2")):
        R.update(path, buckets=4)(rows.where(part), min(number, 1) if number < 3 else 2)
    return R.series(spark, path, "2024-01-01 00:00:00", "2024-02-05 00:00:00", 30)


@query("cumulative_savings", f"{SERIES_SQL} SELECT bucket, cache_hits, CAST(sum(cache_hits) OVER (ORDER BY bucket) AS BIGINT) AS running FROM series")
def cumulative_savings(spark, sf_dir):
    return M.running(_series(spark, sf_dir).select("bucket", "cache_hits"), "cache_hits", "bucket")


_PRICES = [("model-1", 0.513, 1.517), ("model-2", 2.519, 10.021), ("", 1.003, 4.007)]


@query(
    "savings_series",
    f"""{SERIES_SQL}, p AS (SELECT bucket, CAST(0.513 AS DOUBLE) AS i, CAST(1.517 AS DOUBLE) AS o, coalesce(input_tokens, 0) AS a, coalesce(output_tokens, 0) AS b FROM r WHERE cache_hit),
    per AS (SELECT b.bucket, coalesce(round(sum(round((a * i + p.b * o) / 1000000, 6)), 6), 0) AS saved_usd FROM (SELECT unnest(range(30)) AS bucket) b LEFT JOIN p USING (bucket) GROUP BY b.bucket)
    SELECT bucket, saved_usd, round(sum(saved_usd) OVER (ORDER BY bucket), 6) AS running FROM per""",
)
def savings_series(spark, sf_dir):
    prices = spark.createDataFrame(_PRICES, "model string, price_in double, price_out double")
    return M.savings(B.audit(spark, sf_dir), prices, "model-1", "2024-01-01 00:00:00", "2024-02-05 00:00:00", 30)


_ENERGY = {"energy_wh_per_1k_tokens": {"small": 0.3, "large": 2.9, "unknown": 1.5}, "model_class": {"model-1": "small", "model-2": "large", "model-2-x": "small"}, "grid_gco2_per_kwh": {"global": 480.0, "north": 30.0}, "default_region": "global"}


@query(
    "energy_and_co2",
    f"""{WITH}, e AS (SELECT tenant_id, coalesce(cache_hit, false) AS hit, coalesce(total_tokens, 0) AS tokens,
      round(coalesce(total_tokens, 0) / 1000 * CASE WHEN starts_with(lower(model), 'model-1') THEN 0.3 WHEN starts_with(lower(model), 'model-2-x') THEN 0.3 WHEN starts_with(lower(model), 'model-2') THEN 2.9 ELSE 1.5 END, 6) AS wh FROM audit),
    s AS (SELECT tenant_id, round(sum(CASE WHEN NOT hit THEN wh ELSE 0 END), 6) AS energy_wh, round(sum(CASE WHEN NOT hit THEN round(wh / 1000 * 30, 6) ELSE 0 END), 6) AS co2_g,
      round(sum(CASE WHEN hit THEN wh ELSE 0 END), 6) AS energy_avoided_wh, round(sum(CASE WHEN hit THEN round(wh / 1000 * 30, 6) ELSE 0 END), 6) AS co2_avoided_g, sum(tokens) AS tokens FROM e GROUP BY tenant_id)
    SELECT tenant_id, energy_wh, co2_g, energy_avoided_wh, co2_avoided_g, round((energy_wh + energy_avoided_wh) * 1000 / tokens, 6) AS wh_per_1k_blended, 'estimated by model class' AS basis FROM s""",
)
def energy_and_co2(spark, sf_dir):
    return M.footprint(B.audit(spark, sf_dir), rules.energy_table(spark, _ENERGY), rules.grid_factor(_ENERGY, "north"), "estimated by model class", "tenant_id")


@query("provider_share", f"{WITH} SELECT provider, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM audit WHERE provider IS NOT NULL GROUP BY provider")
def provider_share(spark, sf_dir):
    return M.share(B.audit(spark, sf_dir), "provider")


@query("metrics_cube", f"{WITH} SELECT tenant_id, policy_action, provider, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM audit GROUP BY CUBE (tenant_id, policy_action, provider)")
def metrics_cube(spark, sf_dir):
    return M.cube(B.audit(spark, sf_dir), "tenant_id", "policy_action", "provider")


@query("finding_counts", f"{WITH} SELECT tenant_id, list_sort(list(DISTINCT r)) AS rules, count(DISTINCT request_id) AS n FROM (SELECT tenant_id, request_id, unnest(rules_fired) AS r FROM audit) GROUP BY tenant_id")
def finding_counts(spark, sf_dir):
    fired = B.audit(spark, sf_dir).select("tenant_id", "request_id", F.explode("rules_fired").alias("r"))
    return fired.groupBy("tenant_id").agg(F.sort_array(F.collect_set("r")).alias("rules"), F.countDistinct("request_id").alias("n"))


@query("tab_stats", f"{WITH} SELECT user_ref, count(*) AS scans, count(*) FILTER (WHERE policy_action = 'SANITIZE') AS sanitized, count(*) FILTER (WHERE policy_action = 'BLOCK') AS blocked, arg_max(policy_action, ts) AS last FROM audit GROUP BY user_ref")
def tab_stats(spark, sf_dir):
    action = F.col("policy_action")
    return B.audit(spark, sf_dir).groupBy("user_ref").agg(F.count("*").alias("scans"), M.count_if(action == "SANITIZE").alias("sanitized"), M.count_if(action == "BLOCK").alias("blocked"), F.max_by("policy_action", "ts").alias("last"))


HALVES = {"provider": A.OVERWRITE, "total_tokens": A.OVERWRITE, "cache_hit": A.EITHER, "pii_count": A.GREATEST, "rules_fired": A.UNION}


def _halves(spark, sf_dir):
    rows = B.audit(spark, sf_dir)
    ours = rows.where("request_id % 10 <> 3").select("request_id", F.lit(None).cast("string").alias("provider"), "total_tokens", F.lit(False).alias("cache_hit"), "pii_count", "rules_fired")
    gateway = rows.where("request_id % 10 <> 7").select("request_id", "provider", F.when(F.col("request_id") % 2 == 0, F.col("total_tokens") + 1).alias("total_tokens"), "cache_hit", F.lit(1).cast("long").alias("pii_count"), F.array(F.lit("gateway")).alias("rules_fired"))
    return ours, gateway


MERGE_SQL = f"""{WITH}, a AS (SELECT request_id, CAST(NULL AS VARCHAR) AS provider, total_tokens, false AS cache_hit, pii_count, rules_fired FROM audit WHERE request_id % 10 <> 3),
  b AS (SELECT request_id, provider, CASE WHEN request_id % 2 = 0 THEN total_tokens + 1 END AS total_tokens, cache_hit, CAST(1 AS BIGINT) AS pii_count, ['gateway'] AS rules_fired FROM audit WHERE request_id % 10 <> 7)
  SELECT coalesce(b.request_id, a.request_id) AS request_id, coalesce(b.provider, a.provider) AS provider, coalesce(b.total_tokens, a.total_tokens) AS total_tokens,
    coalesce(a.cache_hit, false) OR coalesce(b.cache_hit, false) AS cache_hit, greatest(a.pii_count, b.pii_count) AS pii_count,
    list_sort(list_distinct(list_concat(coalesce(a.rules_fired, []), coalesce(b.rules_fired, [])))) AS rules_fired, a.request_id IS NOT NULL AND b.request_id IS NOT NULL AS was_there
  FROM a FULL JOIN b ON a.request_id = b.request_id"""


@query("audit_merge", MERGE_SQL)
def audit_merge(spark, sf_dir):
    """Both halves as batches of two streams through the commit log, the first of them twice; a flag of each half tells who was there."""
    table = Table(spark, work_folder(spark, "audit"), "request_id", buckets=8)
    ours, gateway = _halves(spark, sf_dir)
    how = {**HALVES, "by_us": A.EITHER, "by_gateway": A.EITHER}
    ours = ours.select("*", F.lit(True).alias("by_us"), F.lit(False).alias("by_gateway"))
    table.merge(ours, how, "ours", 0)
    table.merge(gateway.select("*", F.lit(False).alias("by_us"), F.lit(True).alias("by_gateway")), how, "gateway", 0)
    table.merge(ours, how, "ours", 0)
    return table.read().select("request_id", *HALVES, (F.col("by_us") & F.col("by_gateway")).alias("was_there"))


@query("audit_upsert", f"SELECT * EXCLUDE (was_there) FROM ({MERGE_SQL})")
def audit_upsert(spark, sf_dir):
    """Merging the same half twice changes nothing."""
    ours, gateway = _halves(spark, sf_dir)
    once = A.merge(ours, gateway, "request_id", HALVES).drop("was_there")
    return A.merge(once, gateway, "request_id", HALVES).drop("was_there")


@query("egress_merge", f"{WITH} SELECT request_id, egress_flagged OR request_id % 17 = 0 AS egress_flagged, CASE WHEN request_id % 17 = 0 THEN list_sort(list_distinct(list_concat(rules_fired, ['bias:group']))) ELSE list_sort(rules_fired) END AS rules_fired FROM audit")
def egress_merge(spark, sf_dir):
    rows = B.audit(spark, sf_dir).select("request_id", "egress_flagged", "rules_fired")
    verdicts = rows.where("request_id % 17 = 0").select("request_id", F.lit(True).alias("egress_flagged"), F.array(F.lit("bias:group")).alias("rules_fired"))
    return A.merge(rows, verdicts, "request_id", {"egress_flagged": A.EITHER, "rules_fired": A.UNION}).drop("was_there")


@query("purge_expired", f"{WITH} SELECT tenant_id, count(*) AS left_over FROM audit WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY tenant_id")
def purge_expired(spark, sf_dir):
    """Through the commit log: a stream's batch, retention, and the same batch again, which must bring nothing back."""
    table = Table(spark, work_folder(spark, "audit"), "request_id", buckets=8)
    rows = B.audit(spark, sf_dir).select("request_id", "tenant_id", "ts")
    how = {"tenant_id": A.OVERWRITE, "ts": A.OVERWRITE}
    table.merge(rows, how, "ours", 0)
    table.retain("2024-01-15 00:00:00")
    table.merge(rows, how, "ours", 0)
    return table.read().groupBy("tenant_id").agg(F.count("*").alias("left_over"))


@query("erase_subject", f"{WITH} SELECT user_ref, count(*) AS n FROM audit WHERE CAST(substr(user_ref, 2) AS INT) % 10 <> 4 GROUP BY user_ref")
def erase_subject(spark, sf_dir):
    rows = B.audit(spark, sf_dir)
    subjects = rows.select("user_ref").where(F.substring("user_ref", 2, 9).cast("int") % 10 == 4)
    return A.erase(rows, subjects, "user_ref").groupBy("user_ref").agg(F.count("*").alias("n"))


@query("audit_unique_check", f"{WITH}, doubled AS (SELECT request_id FROM audit UNION ALL SELECT request_id FROM audit WHERE request_id % 100 = 0) SELECT request_id, count(*) AS n FROM doubled GROUP BY request_id HAVING count(*) > 1")
def audit_unique_check(spark, sf_dir):
    """Request ids that break uniqueness, in a table in which every hundredth row stands twice."""
    rows = B.audit(spark, sf_dir).select("request_id")
    return A.duplicates(rows.union(rows.where("request_id % 100 = 0")), "request_id")


@query("audit_page_info", f"{WITH} SELECT count(*) AS total, CAST(ceil(count(*) / 500) AS BIGINT) AS pages, 3 AS page FROM audit")
def audit_page_info(spark, sf_dir):
    return A.page_info(B.audit(spark, sf_dir), 1000, 9999)


@query("audit_record", f"{WITH} SELECT request_id, lower(policy_action) AS action, block_code, len(rules_fired) AS n_rules FROM audit")
def audit_record(spark, sf_dir):
    return A.record(B.audit(spark, sf_dir)).select("request_id", "action", "block_code", F.size("rules_fired").alias("n_rules"))


@query("report_header", f"{WITH} SELECT tenant_id, CAST(sum(pii_count) AS BIGINT) AS pii, CAST(sum(secret_count) AS BIGINT) AS secrets, CAST(sum(pii_count + secret_count) AS BIGINT) AS scrubbed, count(*) FILTER (WHERE policy_action = 'BLOCK') AS blocked FROM audit GROUP BY tenant_id")
def report_header(spark, sf_dir):
    return M.report_header(B.audit(spark, sf_dir), "tenant_id")


@query(
    "spend_and_savings",
    f"""{WITH}, p AS (SELECT tenant_id, cache_hit, CAST(CASE WHEN cache_hit THEN 0.513 WHEN model = 'model-1' THEN 0.513 WHEN model = 'model-2' THEN 2.519 ELSE 1.003 END AS DOUBLE) AS i, CAST(CASE WHEN cache_hit THEN 1.517 WHEN model = 'model-1' THEN 1.517 WHEN model = 'model-2' THEN 10.021 ELSE 4.007 END AS DOUBLE) AS o, coalesce(input_tokens, 0) AS a, coalesce(output_tokens, 0) AS b FROM audit)
    SELECT tenant_id, round(sum(CASE WHEN NOT cache_hit THEN round((a * i + b * o) / 1000000, 6) END), 6) AS spend_usd, round(sum(CASE WHEN cache_hit THEN round((a * i + b * o) / 1000000, 6) END), 6) AS saved_usd FROM p GROUP BY tenant_id""",
)
def spend_and_savings(spark, sf_dir):
    prices = spark.createDataFrame([("model-1", 0.513, 1.517), ("model-2", 2.519, 10.021), ("", 1.003, 4.007)], "model string, price_in double, price_out double")
    return M.spend(B.audit(spark, sf_dir), prices, "model-1", "tenant_id")


@query(
    "review_eligibility",
    f"""WITH {B.AUDIT_SQL}, {B.REVIEWS_SQL} SELECT r.id, r.request_id, CASE WHEN a.policy_action IS NULL THEN 'unknown_request' WHEN a.policy_action <> 'BLOCK' THEN 'not_blocked'
    WHEN a.block_code = 'CREDENTIAL_LEAK_PREVENTED' THEN 'not_appealable' ELSE 'eligible' END AS eligibility FROM reviews r LEFT JOIN audit a USING (request_id)""",
)
def review_eligibility(spark, sf_dir):
    return A.eligibility(B.reviews(spark, sf_dir).select("id", "request_id"), B.audit(spark, sf_dir)).select("id", "request_id", "eligibility")


@query(
    "override_verify",
    f"""WITH {B.REVIEWS_SQL}, p AS (SELECT CASE WHEN n % 11 = 0 THEN '' ELSE 'token-' || (n + n % 3) END AS token, request_id + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS request_id, n FROM reviews)
    SELECT p.n, CASE WHEN p.token = '' THEN 'no_token' WHEN r.request_id IS NULL THEN 'unknown' WHEN r.status <> 'APPROVED' THEN 'not_approved' WHEN r.request_id <> p.request_id THEN 'wrong_request'
      WHEN r.n % 4 = 0 THEN 'already_used' WHEN r.n % 4 = 1 THEN 'expired' ELSE 'valid' END AS result
    FROM p LEFT JOIN reviews r ON sha256(p.token) = r.override_token_hash""",
)
def override_verify(spark, sf_dir):
    r = B.reviews(spark, sf_dir)
    made = r.withColumn("override_used_at", F.when(F.col("n") % 4 == 0, F.col("created_at")))
    made = made.withColumn("override_expires_at", F.when(F.col("n") % 4 == 1, F.lit("1990-01-01")).otherwise("2030-01-01").cast("timestamp"))
    token = F.when(F.col("n") % 11 == 0, "").otherwise(F.concat(F.lit("token-"), F.col("n") + F.col("n") % 3))
    presented = r.select(token.alias("token"), (F.col("request_id") + F.when(F.col("n") % 5 == 0, 1).otherwise(0)).alias("request_id"), "n", F.lit("2024-06-01").cast("timestamp").alias("as_of"))
    return A.verify_override(presented, made).select("n", "result")


@query("latest_review", f"WITH {B.REVIEWS_SQL} SELECT request_id, status, n FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, n DESC) AS k FROM reviews) WHERE k = 1")
def latest_review(spark, sf_dir):
    return A.latest(B.reviews(spark, sf_dir).select("request_id", "status", "n", "created_at"), "request_id", [F.desc("created_at"), F.desc("n")]).drop("created_at")


@query("latest_run", f"{WITH} SELECT tenant_id, arg_max(request_id, ts) AS last_request FROM audit GROUP BY tenant_id")
def latest_run(spark, sf_dir):
    return B.audit(spark, sf_dir).groupBy("tenant_id").agg(F.max_by("request_id", "ts").alias("last_request"))


_PADS = [bytes(b ^ pad for b in b"pepper".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query("user_hash", f"SELECT user_id, substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('u' || user_id)))), 1, 32) AS h FROM (SELECT DISTINCT user_id FROM events)")
def user_hash(spark, sf_dir):
    users = B.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", A.user_hash(F.concat(F.lit("u"), "user_id"), "pepper").alias("h"))
