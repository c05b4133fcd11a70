"""The gateway's view of an inspection: outward categories, actions, error codes and stage states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed as X


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def category(kind: Column, family: Column) -> Column:
    """The gateway's name of a finding's type: unknown secrets are API keys, unknown personal types PII_ and the type."""
    return F.when(family == "SECRET", F.coalesce(_looked_up(X.GATEWAY_SECRET, kind), F.lit("SECRET_API_KEY"))).otherwise(F.coalesce(_looked_up(X.GATEWAY_PERSONAL, kind), F.concat(F.lit("PII_"), kind)))


def stage_status(status: Column) -> Column:
    return F.coalesce(_looked_up(X.STAGE_STATUS, status), F.lit("skipped"))


def error_code(decision: Column, code: Column, secrets: Column, injected: Column, personal: Column) -> Column:
    """Why a request was blocked: the block's own code where the gateway knows it, else by what was found."""
    own = F.when(code.isin("CREDENTIAL_LEAK_PREVENTED", "PROMPT_INJECTION_BLOCKED"), code).when(F.startswith(code, F.lit("PII")), "PII_LEAK_PREVENTED")
    by = F.when(secrets > 0, "CREDENTIAL_LEAK_PREVENTED").when(injected, "PROMPT_INJECTION_BLOCKED").when(personal > 0, "PII_LEAK_PREVENTED").otherwise("POLICY_VIOLATION")
    return F.when(decision == "block", F.coalesce(own, by))


def verdicts(inspected: DataFrame, at: float = 0.5) -> DataFrame:
    """(request_id, action, error_code, sanitized, vault, stages, categories) of ``inspect`` rows; sanitised texts and vault only where something was sanitised; categories by the gateway's names, sorted."""
    injected = F.col("injection_score") >= at
    code = F.when(F.startswith("block_rule", F.lit("secret")), "CREDENTIAL_LEAK_PREVENTED").when(F.startswith("block_rule", F.lit("injection")), "PROMPT_INJECTION_BLOCKED").when(F.startswith("block_rule", F.lit("pii")), "PII_BLOCKED")
    sanitized = F.col("decision") == "sanitize"
    return inspected.select(
        "request_id",
        F.col("decision").alias("action"),
        error_code(F.col("decision"), F.coalesce(code, F.lit("")), F.col("secret_count"), injected, F.col("pii_count")).alias("error_code"),
        F.when(sanitized, F.col("redacted")).alias("sanitized"),
        F.when(sanitized & (F.size("vault") > 0), F.col("vault")).alias("vault"),
        F.transform("stages", lambda s: F.struct(s["stage"].alias("name"), stage_status(s["status"]).alias("status"))).alias("stages"),
        F.array_sort(F.array_distinct(F.transform("found_types", lambda x: category(x["type"], x["category"])))).alias("categories"),
    )
