"""The breaker over many partitions against the plain fold, one key over all of them too."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.streaming import runs
from wardline.streaming.limits import breaker_step


def plain(rows, failures, cool):
    out, state = {}, {}
    for key, seq, now, ok in sorted(rows, key=lambda r: (r[0], r[1])):
        state[key], what = breaker_step(state.get(key), now, bool(ok), failures, cool)
        out[key, seq] = (what, state[key][0])
    return out


def events(n, seed, good=0.6, keys=("a",), backwards=False):
    rng, now, out = random.Random(seed), 0.0, []
    for i in range(n):
        now += rng.choice([0.0, 0.5, 1.0, 7.0, 31.0]) if not (backwards and rng.random() < 0.2) else -rng.random() * 20
        out.append((rng.choice(keys), i, now, rng.random() < good))
    return out


def test_summaries_are_what_the_fold_does():
    rng = random.Random(1)
    for trial in range(300):
        rows = events(rng.randrange(0, 30), trial, rng.choice([0.1, 0.5, 0.9]), backwards=trial % 3 == 0)
        now, ok = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], bool)
        failures, cool = rng.choice([1, 2, 3, 5]), rng.choice([0.0, 0.1, 30.0, 1000.0])
        cut = rng.randrange(0, len(rows) + 1)
        whole = runs.summary(now, ok, failures, cool)
        parts = runs.summary(now[:cut], ok[:cut], failures, cool).then(runs.summary(now[cut:], ok[cut:], failures, cool))
        openings = {-1e9, -0.1, 0.0, *(t - cool for t in now[:5]), *(now[:5].tolist()), 1e9}
        for begin in [("CLOSED", c, 0.0) for c in range(failures)] + [("OPEN", 0, t) for t in openings]:
            state = begin
            for t, good in zip(now.tolist(), ok.tolist(), strict=True):
                state, _ = breaker_step(state, t, good, failures, cool)
            same = lambda s: (s[0], s[1] if s[0] == "CLOSED" else 0, s[2])
            assert same(whole.after(begin)) == same(state) == same(parts.after(begin)), (trial, begin)
        assert len(whole.steps) <= len(rows)


@pytest.mark.parametrize(("keys", "n", "good"), [(("a",), 20_000, 0.5), (("a", "b", "hot", "hot", "hot", "hot"), 6000, 0.3), (tuple("abcdefghij"), 500, 0.9)])
def test_breaker_over_partitions(spark, keys, n, good):
    rows = events(n, 11, good, keys)
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, seq long, now_s double, ok boolean, part string").repartition(5)
    for failures, cool in ((3, 30.0), (1, 2.0)):
        got = runs.breaker(df, failures, cool, parts=8)
        assert {(r["key"], r["seq"]): (r["outcome"], r["mode"]) for r in got.collect()} == plain(rows, failures, cool)


def test_one_key_is_spread(spark):
    df = spark.createDataFrame([("a", i, float(i), i % 3 == 0) for i in range(8000)], "key string, seq long, now_s double, ok boolean")
    runs.breaker(df, parts=8).count()
    import glob

    folder = max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/runs-*"), key=lambda p: __import__("os").path.getmtime(p))
    sizes = [r["count"] for r in spark.read.parquet(f"{folder}/events").groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * 8000 / 8


def test_odd_rows(spark):
    schema = "key string, seq long, now_s double, ok boolean"
    df = spark.createDataFrame([(None, 1, 0.0, True), ("a", None, 0.0, True), ("a", 1, 0.0, None), ("a", 2, None, True), ("b", 1, 0.0, False)], schema)
    assert sorted(map(tuple, runs.breaker(df, failures=1).collect())) == [("a", 1, "failed", "OPEN"), ("b", 1, "failed", "OPEN")]
    assert runs.breaker(df.limit(0)).collect() == [] and runs.breaker(df.where(F.lit(False))).columns == ["key", "seq", "outcome", "mode"]
