"""Round 3: what is held is worked out once, where it stands."""

from pyspark.sql import functions as F

from wardline.operators import detect as D
from wardline.operators import spans as S
from wardline.plans import corpus_queries as Q


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_held_values_stay_below_a_filter(spark):
    plan = _plan(spark.range(5).select(S.held(F.col("id") * 7).alias("x")).where("x > 3"))
    assert plan.count("* 7") == 1 and plan.lstrip().startswith("Filter")


def test_the_secret_corpus_tries_its_patterns_once_above_the_dealing(spark, sf_dir):
    plan = _plan(Q.secret_corpus(spark, sf_dir))
    assert "github_pat_" not in plan[plan.index("RepartitionByExpression") :]


def test_few_and_many_matches_of_a_text_are_told_alike(spark):
    part = "u@x.example.com 123-45-6789"
    rows = spark.createDataFrame([(1, part), (2, " ".join([part] * 5)), (3, f"{S.SIGN} {part}")], "k int, t string")
    got = sorted((r["k"], r["start"], r["value"], r["type"], r["confidence"]) for r in D.findings(rows, "t", ["k"]).collect())
    one = [x[1:] for x in got if x[0] == 1]
    assert [x[1] for x in one] == ["u@x.example.com", "123-45-6789", "123-45-6789"]
    assert [x[1:] for x in got if x[0] == 2] == sorted((s + i * 28, *rest) for i in range(5) for s, *rest in one)
    assert [x[1:] for x in got if x[0] == 3] == [(s + 2, *rest) for s, *rest in one]
