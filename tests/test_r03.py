"""What round 3 found: shared steps that ran more than once a row, in few tasks, or left something unexplained."""

from wardline.operators import inspect as N
from wardline.plans import corpus_queries as Q

def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()

def test_leak_check_reads_its_texts_once(spark, sf_dir):
    out = Q.leak_check(spark, sf_dir)
    assert _plan(out).count("Relation [") == 1
    assert all(r["leaks"] == (r["request_id"] % 4 == 0) for r in out.collect())

def test_few_row_groups_do_not_mean_few_tasks(spark, sf_dir):
    assert Q._orders(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

def test_a_finding_explains_its_token(spark):
    rows = spark.createDataFrame([(1, 0, "user", "mail u123456@x.example.com"), (2, 0, "user", "what is qX7$kPz!93LmW#vR2dTy8")], "request_id long, message_index int, role string, content string")
    got = {r["request_id"]: r["entropy_count"] for r in N.inspect(rows, Q._rules(spark)).collect()}
    assert got == {1: 0, 2: 1}


def test_entropy_is_worked_out_once_in_many_tasks(spark, sf_dir):
    from wardline.plans import text_queries

    out = text_queries.token_entropy(spark, sf_dir)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert _plan(out).count("log2") + _plan(out).count("LOG2") == 1


def test_added_lines_sort_once(spark):
    from wardline.sources import streams

    lines = ["--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@", " a", "+b", "-c", "+d", "@@ -9 +20,2 @@", "-e", "+f", " g", "--- a/y", "+++ b/y", "@@ -0,0 +1 @@", "+h"]
    out = streams.added_lines(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "diff_id int, seq int, line string"))
    assert sorted(map(tuple, out.collect())) == [("x", 2), ("x", 3), ("x", 20), ("y", 1)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window") >= 1
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Sort [") == 1


def test_both_screens_read_the_texts_once(spark, sf_dir):
    assert _plan(Q.screened_documents(spark, sf_dir)).count("Relation [") == 1


def test_screens_keep_what_their_gates_let_through(spark):
    from wardline.functions import fixed
    from wardline.operators import detect

    rows = spark.createDataFrame([(1, "How  to kill someone, and all immigrants are lazy"), (2, "kill the process"), (3, None), (4, "WHY NOT end it")], "k int, t string")
    got = {(r["k"], r["screen"]): (r["score"], r["categories"]) for r in detect.screens(rows, "t", ["k"], {"harm": (fixed.HARM_SCREEN, None), "bias": (fixed.BIAS_SCREEN, fixed.GROUPS)}).collect()}
    assert got == {(1, "harm"): (0.9, ["violence"]), (1, "bias"): (0.7, ["generalization"]), (4, "harm"): (0.95, ["self_harm"])}
