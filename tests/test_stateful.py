"""Streams with state against plain folds: cut into batches, restarted, told twice, with time passing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import audit as A
from wardline.plans.corpus_queries import SCRIPTS
from wardline.streaming import stateful as S

pytest.importorskip("google.protobuf")


class Feed:
    """Batches written as files, one batch a trigger; each ``run`` is a new query on the same checkpoint."""

    def __init__(self, spark, tmp_path, schema, build, mode="append"):
        self.spark, self.root, self.schema, self.build, self.mode, self.n = spark, tmp_path, schema, build, mode, 0
        self.rows = {}
        self.progress = None

    def add(self, rows):
        df = self.spark.createDataFrame(rows, self.schema)
        if "ts" in df.columns:
            df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        self.stored = df.schema
        df.coalesce(1).write.parquet(str(self.root / "in" / f"b={self.n:03d}"))
        self.n += 1

    def run(self):
        got = []
        stream = self.spark.readStream.schema(self.stored).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(self.root / "in"))
        with S.state_store(self.spark):
            writer = self.build(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
            q = writer.outputMode(self.mode).option("checkpointLocation", str(self.root / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        self.progress = q.lastProgress
        return got


# the cache

CACHE = "tenant string, guards string, seq long, request_id string, action string, categories array<string>, embedding array<float>, response string"


def requests(n=160):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = []
    for i in range(n):
        v = [x + rng.gauss(0, rng.choice([0.0, 0.05, 0.5])) for x in rng.choice(base)]
        if i % 23 == 7:
            v = rng.choice([None, [], [0.0] * 6, [1.0], [float("nan")] * 6])
        out.append((rng.choice("ab"), rng.choice([None, "", "not"]), i, f"r{i}", rng.choice(["allow", "sanitize", "WARN", "block", None]), rng.choice([None, [], ["PII"], ["SECRET.x"]]), v, None if i % 17 == 3 else f"answer {i}"))
    return out


def plain_cache(rows, threshold, capacity):
    kept, out = {}, []
    for tenant, guards, seq, rid, action, categories, v, response in sorted(rows, key=lambda r: r[2]):
        entries = kept.setdefault((tenant, guards or ""), [])
        x = np.array(v, "f4").astype(float) if v else np.zeros(1)
        n = np.sqrt((x * x).sum())
        if not v or not np.isfinite(n) or n == 0 or (action or "").lower() in ("warn", "block") or any(c.startswith("SECRET") for c in categories or []):
            out.append((tenant, seq, rid, "bypass", None, None))
            continue
        x = x / n
        scored = [(-round(float(x @ w), 6), k) for k, (w, _) in enumerate(entries) if len(w) == len(x)]
        if scored and -min(scored)[0] >= threshold:
            s, k = min(scored)
            out.append((tenant, seq, rid, "hit", -s, entries[k][1]))
        elif response is None:
            out.append((tenant, seq, rid, "miss", None, None))
        else:
            entries.append((x, response))
            del entries[:-capacity]
            out.append((tenant, seq, rid, "stored", None, None))
    return out


def cleaned(rows):
    return sorted((t, s, r, o, None if m is None or m != m else m, a) for t, s, r, o, m, a in rows)


def test_cache_stream_equals_the_fold(spark, tmp_path):
    rows = requests()
    feed = Feed(spark, tmp_path, CACHE, lambda d: S.cache_stream(d, 0.92, capacity=4))
    got = []
    for at in (0, 40, 41, 100):  # each cut is a restart from the checkpoint
        feed.add(rows[at : {0: 40, 40: 41, 41: 100, 100: 160}[at]])
        got += feed.run()
    want = cleaned(plain_cache(rows, 0.92, 4))
    assert cleaned(got) == want and {o for *_, o, _, _ in want} == {"bypass", "hit", "miss", "stored"}


# the vault


def test_vault_values_die(spark, tmp_path):
    feed = Feed(spark, tmp_path, "request_id string, seq long, ts string, op string, placeholder string, value string", lambda d: S.vault_stream(d, 60))
    feed.add([("r1", 0, "2024-01-01 00:00:00", "put", "<A_1>", "ann"), ("r1", 1, "2024-01-01 00:00:10", "get", "<A_1>", None), ("r1", 2, "2024-01-01 00:00:11", "get", "<B_1>", None), ("r2", 0, "2024-01-01 00:00:05", "put", "<A_1>", "bob")])
    assert sorted(feed.run()) == sorted([("r1", 1, "<A_1>", "ann"), ("r1", 2, "<B_1>", None)])
    feed.add([("r1", 3, "2024-01-01 00:00:59", "get", "<A_1>", None), ("r1", 4, "2024-01-01 00:00:59", "put", "<C_1>", None), ("r1", 5, "2024-01-01 00:01:00", "get", "<A_1>", None), ("r2", 1, "2024-01-01 00:00:50", "put", "<A_1>", "bert"), ("r2", 2, "2024-01-01 00:01:20", "get", "<A_1>", None)])
    assert sorted(map(str, feed.run())) == sorted(map(str, [("r1", 3, "<A_1>", "ann"), ("r1", 5, "<A_1>", None), ("r2", 2, "<A_1>", "bert")]))
    held = lambda: sum(o.numRowsTotal for o in feed.progress.stateOperators)
    assert held() > 0
    feed.add([("r9", 0, "2024-01-01 02:00:00", "get", "<A_1>", None)])
    feed.run()
    feed.add([("r9", 1, "2024-01-01 02:00:01", "get", "<A_1>", None)])
    feed.run()
    assert held() == 0  # the watermark has passed all lives
    feed.add([("r2", 3, "2024-01-01 02:00:02", "get", "<A_1>", None)])
    assert feed.run() == [("r2", 3, "<A_1>", None)]


# reviews


@pytest.mark.parametrize("cuts", [[], [1, 2, 3, 4], [2], [0, 3]])
def test_reviews_in_any_batches(spark, tmp_path, cuts):
    events = []
    for k in range(8):
        for seq, (event, minute, *_) in enumerate(SCRIPTS[k % len(SCRIPTS)]):
            token = "someone else's" if event == "other" else f"h{k}" if event in ("approve", "use") else None
            events.append((str(k), seq, f"2024-01-01 00:{minute:02d}:00" if minute < 60 else "2024-01-05 00:00:00", "use" if event == "other" else event, token))
    schema = "request_id string, seq long, ts string, event string, token_hash string"
    feed = Feed(spark, tmp_path, schema, lambda d: S.review_stream(d, 3600), mode="update")
    got, parts = [], [sorted(r for r in events if lo <= r[1] < hi) for lo, hi in zip([0, *cuts], [*cuts, 99], strict=True)]
    for part in parts:
        if part:
            feed.add(part)
            feed.add(part[: len(part) // 2])  # told twice: nothing comes of it
            got += feed.run()
    df = spark.createDataFrame(events, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    want = A.review_states(df, 3600).select("request_id", "seq", "outcome", "status")
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in want.collect())
    assert sum(o == "used" for _, _, o, _ in got) == 4
