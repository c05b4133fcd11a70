"""Functions for SQL: masks, fingerprints and scores as SQL expressions, and a table function that scans texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from wardline.operators import injection as I

#: name, arguments, result, expression
SCALARS = (
    ("mask_preview", "v STRING", "STRING", "CASE WHEN length(v) <= 8 THEN repeat('*', length(v)) WHEN length(v) <= 12 THEN concat(left(v, 2), repeat('*', least(12, length(v) - 4)), right(v, 2)) ELSE concat(left(v, 4), repeat('*', least(12, length(v) - 8)), right(v, 4)) END"),
    ("finding_fingerprint", "path STRING, kind STRING, v STRING", "STRING", "substring(sha2(concat_ws(chr(0), path, kind, v), 256), 1, 16)"),
    ("noisy_or", "weights ARRAY<DOUBLE>", "DOUBLE", "round(1 - aggregate(weights, 1D, (acc, w) -> acc * (1 - w)), 3)"),
    ("token_estimate", "v STRING", "BIGINT", "ceil(length(v) / 4)"),
)


@udtf(returnType="rule_id string, category string, weight double, via string")
class ScanText:
    """The injection rules, needles and evasion signs that a text shows, one row each; null shows none."""

    def __init__(self) -> None:
        self.rules = I.Rules()

    def eval(self, text: str) -> Iterator[tuple[str, str, float, str]]:
        yield from self.rules.hits(text or "")


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: mask_preview, finding_fingerprint, noisy_or, token_estimate, and scan_text for LATERAL."""
    for name, arguments, result, expression in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {expression}")
    spark.udtf.register("scan_text", ScanText)
