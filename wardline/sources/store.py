"""The audit store: its tables, reading and writing them, and the same over a database connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, columns, partition column
TABLES = (
    ("request_audit", "request_id STRING NOT NULL, tenant_id STRING, user_ref_hash STRING, ts TIMESTAMP, provider STRING, model STRING, policy_action STRING, policy_profile STRING, policy_version INT, block_code STRING, rules_fired ARRAY<STRING>, pii_count INT, pii_types ARRAY<STRING>, secret_count INT, secret_types ARRAY<STRING>, entropy_count INT, injection_score DOUBLE, cache_hit BOOLEAN, cache_similarity DOUBLE, failover_used BOOLEAN, failover_from STRING, failover_to STRING, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT, latency_total_ms DOUBLE, latency_inspect_ms DOUBLE, latency_provider_ms DOUBLE, estimated_cost_usd DOUBLE, estimated_savings_usd DOUBLE, egress_flagged BOOLEAN, review_id STRING, schema_version INT, day DATE", "day"),
    ("review_requests", "id STRING NOT NULL, request_id STRING, tenant_id STRING, created_at TIMESTAMP, requester_ref_hash STRING, original_decision STRING, rule_fired STRING, user_justification STRING, status STRING, reviewer_ref_hash STRING, reviewer_note STRING, decided_at TIMESTAMP, override_token_hash STRING, override_expires_at TIMESTAMP, override_used_at TIMESTAMP", None),
    ("policy_versions", "version INT NOT NULL, body STRING, author_ref_hash STRING, created_at TIMESTAMP, diff_summary STRING, note STRING", None),
    ("fairness_runs", "run_id STRING NOT NULL, label STRING, run_at TIMESTAMP, grp STRING, recall DOUBLE, prec DOUBLE, n BIGINT", None),
)
#: columns that must be unique, as there are no constraints in a folder of files
UNIQUE = {"request_audit": "request_id", "review_requests": "id", "policy_versions": "version"}


def create(spark: SparkSession, database: str) -> None:
    """The store's tables, where they are not there yet; audit rows by day, so that a window reads its days only."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns, by in TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet" + (f" PARTITIONED BY ({by})" if by else ""))


def append(rows: DataFrame, database: str, name: str) -> None:
    """Rows added to a table by column name; what the rows lack is null, and an audit row's day is that of its time."""
    table = rows.sparkSession.table(f"{database}.{name}")
    if "day" in table.columns and "day" not in rows.columns:
        rows = rows.withColumn("day", F.to_date("ts"))
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]).write.insertInto(f"{database}.{name}")


def broken(spark: SparkSession, database: str, name: str) -> DataFrame:
    """Keys of a table that stand in more than one row."""
    from wardline.operators import audit as A

    return A.duplicates(spark.table(f"{database}.{name}"), UNIQUE[name])


def jdbc_read(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parts by ranges of a number column, each by a connection of its own."""
    return spark.read.options(**options).jdbc(url, table, column, low, high, parts)


def jdbc_write(rows: DataFrame, url: str, table: str, mode: str = "append", parts: int = 8, **options: str) -> None:
    """Rows written to a database table by at most so many connections."""
    rows.coalesce(parts).write.options(**options).jdbc(url, table, mode)
