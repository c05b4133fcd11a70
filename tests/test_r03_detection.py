"""Round 3, the step that redaction, corpora and cache hints share: detection in two columns, patterns not compiled for every row."""

import re

from pyspark.sql import functions as F

from wardline.functions import fixed
from wardline.operators import detect as D
from wardline.operators import inspect as N
from wardline.operators import spans as S
from wardline.plans import corpus_queries as Q


def test_findings_need_two_projections(spark, sf_dir):
    plan = N.with_findings(Q._mails(spark, sf_dir), N.FIRST, N.LAST)._jdf.queryExecution().optimizedPlan().toString()
    assert len(N._steps("plan", N.FIRST, N.LAST)) == 2
    assert "mapinarrow" not in Q.redact_by_policy(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower() and "found" in plan


def test_pairs_are_those_of_the_pattern_with_and_without_the_sign(spark):
    texts = ["a@b.com%x@y.org and u@v.w, q.r@s.co", "none", "", None, f"é {S.SIGN}a@b.com{S.SIGN} c@d.org", "$0 \\ a@b.de", "a@b a@b.c x@y.zz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    for pattern in (fixed.EMAIL, fixed.EMAIL_ANCHORED):
        for r in rows.select("t", S.pairs(F.col("t"), pattern).alias("p")).collect():
            at, want = 0, []
            for m in re.finditer(fixed.EMAIL, r["t"] or ""):
                want.append((m.start() - at, m.group()))
                at = m.end()
            assert [(x["gap"], x["v"]) for x in r["p"] or []] == want


def test_many_matches_of_a_text_keep_their_places(spark):
    text = " ".join(f"u{i}@x.example.com {100 + i}-45-6789" for i in range(1, 40))
    rows = spark.createDataFrame([(1, text), (2, text[:60])], "k int, t string")
    for r in D.findings(rows, "t", ["k"]).collect():
        assert text[r["start"] : r["end"]] == r["value"]
    assert D.findings(rows, "t", ["k"]).where("k = 1 and type = 'EMAIL_ADDRESS'").count() == 39


def test_a_gate_lets_through_all_that_its_pattern_matches(spark):
    rows = spark.createDataFrame([(1, "password\t= hunter2hunter2"), (2, "BEARER abcdefghijklmnopqrst"), (3, "name@YBL, x"), (4, "4111 1111 1111 1111")], "k int, t string")
    got = {r["k"]: r["type"] for r in D.findings(rows, "t", ["k"], (*D.PERSONAL, *D.SECRETS)).where("type not in ('PHONE_NUMBER', 'IN_AADHAAR')").collect()}
    assert got == {1: "GENERIC_SECRET", 2: "BEARER_TOKEN", 3: "IN_UPI_ID", 4: "CREDIT_CARD"}
