"""Per-key state over ordered events: token bucket, fixed window, circuit breaker, expiry; replayed in batch or run as a stream.

The state machines are plain functions over (state, event), shared by the
batch replay (applyInPandas on the key) and the streaming processors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_STATE = "tokens double, at double"
BREAKER_STATE = "mode string, failures int, opened double"


def bucket_step(state: tuple[float, float] | None, now: float, per_minute: float, burst: float) -> tuple[tuple[float, float], bool, float]:
    """(new state, allowed, seconds to wait): the bucket refills by elapsed time and gives one token a request."""
    tokens, at = state or (burst, now)
    tokens = min(burst, tokens + max(0.0, now - at) * per_minute / 60)
    if tokens >= 1:
        return (tokens - 1, now), True, 0.0
    return (tokens, now), False, (1 - tokens) * 60 / per_minute


def breaker_step(state: tuple[str, int, float] | None, now: float, ok: bool, failures: int = 3, cool: float = 30.0) -> tuple[tuple[str, int, float], str]:
    """(new state, what happened): closed until consecutive failures, open for the cooling time, then one trial."""
    mode, count, opened = state or ("CLOSED", 0, 0.0)
    if mode == "OPEN":
        if now - opened < cool:
            return (mode, count, opened), "refused"
        mode = "HALF_OPEN"
    if ok:
        return ("CLOSED", 0, 0.0), "ok"
    if mode == "HALF_OPEN" or count + 1 >= failures:
        return ("OPEN", count + 1, now), "failed"
    return ("CLOSED", count + 1, 0.0), "failed"


def replay_bucket(events: DataFrame, per_minute: float = 600, burst: float = 60) -> DataFrame:
    """events (key, seq, now_s) in order of seq within the key: allowed and retry_after of each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = None, []
        for key, seq, now in pdf.sort_values("seq")[["key", "seq", "now_s"]].itertuples(index=False):
            state, allowed, wait = bucket_step(state, now, per_minute, burst)
            rows.append((key, seq, allowed, round(wait, 6)))
        return pd.DataFrame(rows, columns=["key", "seq", "allowed", "retry_after"])

    return events.select("key", "seq", "now_s").groupBy("key").applyInPandas(run, "key string, seq long, allowed boolean, retry_after double")


def replay_breaker(events: DataFrame, failures: int = 3, cool: float = 30.0) -> DataFrame:
    """events (key, seq, now_s, ok): the breaker's mode after each, and whether it was let through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = None, []
        for key, seq, now, ok in pdf.sort_values("seq")[["key", "seq", "now_s", "ok"]].itertuples(index=False):
            state, what = breaker_step(state, now, bool(ok), failures, cool)
            rows.append((key, seq, what, state[0]))
        return pd.DataFrame(rows, columns=["key", "seq", "outcome", "mode"])

    return events.select("key", "seq", "now_s", "ok").groupBy("key").applyInPandas(run, "key string, seq long, outcome string, mode string")


def fixed_window(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Tumbling windows: requests of each key and how many were over the limit."""
    n = events.groupBy("key", F.floor(F.unix_timestamp("ts") / seconds).alias("slot")).agg(F.count("*").alias("n"))
    return n.withColumn("rejected", F.greatest(F.lit(0), F.col("n") - limit))


def alive(issued: Column, as_of: Column, seconds: int) -> Column:
    return issued + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)) > as_of


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Runs of a key's events with no longer pause than the gap."""
    s = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n", "total")


def tumbling(events: DataFrame, width: str, *by: str) -> DataFrame:
    """Counts and sums by event-time window; over a stream, give it a watermark first."""
    return events.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def bucket_stream(events: DataFrame, per_minute: float = 600, burst: float = 60) -> DataFrame:
    """The token bucket as a stateful stream over (key, seq, now_s)."""
    from pyspark.sql.streaming import StatefulProcessor

    class Bucket(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("bucket", BUCKET_STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            state = tuple(self.state.get()) if self.state.exists() else None
            out = []
            for seq, now in pd.concat(list(rows)).sort_values("seq")[["seq", "now_s"]].itertuples(index=False):
                state, allowed, wait = bucket_step(state, now, per_minute, burst)
                out.append((key[0], seq, allowed, round(wait, 6)))
            self.state.update(state)
            yield pd.DataFrame(out, columns=["key", "seq", "allowed", "retry_after"])

        def close(self) -> None:
            pass

    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=Bucket(), outputStructType="key string, seq long, allowed boolean, retry_after double", outputMode="Append", timeMode="None")


def breaker_stream(events: DataFrame, failures: int = 3, cool: float = 30.0) -> DataFrame:
    """The circuit breaker as a stateful stream over (key, seq, now_s, ok)."""
    from pyspark.sql.streaming import StatefulProcessor

    class Breaker(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("breaker", BREAKER_STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            state = tuple(self.state.get()) if self.state.exists() else None
            out = []
            for seq, now, ok in pd.concat(list(rows)).sort_values("seq")[["seq", "now_s", "ok"]].itertuples(index=False):
                state, what = breaker_step(state, now, bool(ok), failures, cool)
                out.append((key[0], seq, what, state[0]))
            self.state.update(state)
            yield pd.DataFrame(out, columns=["key", "seq", "outcome", "mode"])

        def close(self) -> None:
            pass

    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=Breaker(), outputStructType="key string, seq long, outcome string, mode string", outputMode="Append", timeMode="None")
