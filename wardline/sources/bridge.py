"""The warehouse tables seen as the engine's own: audit rows, messages, reviews, cache entries.

Every rule is integer arithmetic on ids, so SQL can repeat it (``*_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the end of every window, as no query reads the clock
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(keys: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by their key to as many tasks as a shuffle has, before something costly is made of each: a file of few row groups is read by few tasks."""
    spark = keys.sparkSession
    least = 3 * spark.sparkContext.defaultParallelism
    return keys.repartition(max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_audit rows from the event stream."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    provider = F.when(n % 4 == 0, "alpha").when(n % 4 == 1, "beta").when(n % 4 == 2, "gamma")
    kind = F.col("event_type")
    return e.select(
        n.alias("request_id"),
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"),
        F.concat(F.lit("u"), "user_id").alias("user_ref"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "click", "WARN").when(kind == "signup", "SANITIZE").when(kind == "error", "BLOCK").otherwise("ALLOW").alias("policy_action"),
        F.when(kind == "error", F.when(n % 2 == 0, "PROMPT_INJECTION_BLOCKED").otherwise("CREDENTIAL_LEAK_PREVENTED")).alias("block_code"),
        provider.alias("provider"),
        F.concat(F.lit("model-"), n % 5).alias("model"),
        F.col("value").alias("latency_total_ms"),
        (F.col("value") / 10).alias("latency_inspect_ms"),
        F.when(provider.isNotNull(), F.col("value") / 2).alias("latency_provider_ms"),
        k.alias("input_tokens"),
        (k * 2).alias("output_tokens"),
        (k * 3).alias("total_tokens"),
        (n % 5 == 0).alias("cache_hit"),
        (n % 11 == 0).alias("failover_used"),
        F.when(n % 11 == 0, "alpha").alias("failover_from"),
        F.when(n % 11 == 0, "beta").alias("failover_to"),
        (n % 3).alias("pii_count"),
        F.when(n % 7 == 0, 1).otherwise(0).cast("long").alias("secret_count"),
        F.array_compact(F.array(F.concat(F.lit("rule-"), F.col("user_id") % 6), F.when(n % 2 == 0, "rule-even"))).alias("rules_fired"),
        (n % 13 == 0).alias("egress_flagged"),
        (n % 4).alias("policy_version"),
    )


AUDIT_SQL = """audit AS (
  SELECT event_id AS request_id, 't' || (user_id % 3) AS tenant_id, 'u' || user_id AS user_ref, ts,
    CASE event_type WHEN 'click' THEN 'WARN' WHEN 'signup' THEN 'SANITIZE' WHEN 'error' THEN 'BLOCK' ELSE 'ALLOW' END AS policy_action,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'PROMPT_INJECTION_BLOCKED' ELSE 'CREDENTIAL_LEAK_PREVENTED' END END AS block_code,
    CASE event_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' END AS provider,
    'model-' || (event_id % 5) AS model, value AS latency_total_ms, value / 10 AS latency_inspect_ms,
    CASE WHEN event_id % 4 < 3 THEN value / 2 END AS latency_provider_ms,
    k AS input_tokens, k * 2 AS output_tokens, k * 3 AS total_tokens, event_id % 5 = 0 AS cache_hit, event_id % 11 = 0 AS failover_used,
    CASE WHEN event_id % 11 = 0 THEN 'alpha' END AS failover_from, CASE WHEN event_id % 11 = 0 THEN 'beta' END AS failover_to,
    event_id % 3 AS pii_count, CAST(event_id % 7 = 0 AS BIGINT) AS secret_count,
    CASE WHEN event_id % 2 = 0 THEN ['rule-' || (user_id % 6), 'rule-even'] ELSE ['rule-' || (user_id % 6)] END AS rules_fired,
    event_id % 13 = 0 AS egress_flagged, event_id % 4 AS policy_version
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review requests from orders: F is denied, O pending, P approved."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "DENIED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("APPROVED")
    return o.select(
        F.concat(F.lit("r"), "o_orderkey").alias("id"),
        (F.col("o_orderkey") % 10000).alias("request_id"),
        F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        status.alias("status"),
        F.when(status == "APPROVED", F.sha2(F.concat(F.lit("token-"), "o_orderkey"), 256)).alias("override_token_hash"),
        F.col("o_orderkey").alias("n"),
    )


REVIEWS_SQL = """reviews AS (
  SELECT 'r' || o_orderkey AS id, o_orderkey % 10000 AS request_id, 't' || (o_custkey % 3) AS tenant_id, o_orderdate AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'DENIED' WHEN 'O' THEN 'PENDING' ELSE 'APPROVED' END AS status,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN sha256('token-' || o_orderkey) END AS override_token_hash, o_orderkey AS n FROM orders)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: request_id, message_index, role, content."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("message_index"), "role", F.coalesce("text", F.lit("")).alias("content"))


MESSAGES_SQL = "messages AS (SELECT conv_id AS request_id, turn AS message_index, role, coalesce(text, '') AS content FROM conversations)"
