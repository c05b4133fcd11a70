"""A circuit breaker replayed over all partitions at once, a hot key too.

Events are range-partitioned by key and order, so a key may go over many partitions. What a partition's part of a key does depends on
the state it begins with, which is what the parts before it leave. So each partition first folds the part that
continues a key to a summary: for each state it could begin with, the state it leaves. Summaries are put one after the other (a
row a partition reaches the driver), which gives every partition the state to begin with; then all finish alone.

The summary of a part is a function of few values: a closed breaker begins with fewer failures than it takes to open; an open one lets the first
event through that is late enough, so its end depends on its opening time by steps, one for each event that is
later than all before it; neighbouring steps with one end are one step.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import work_folder
from wardline.streaming.limits import breaker_step

State = tuple[str, int, float]
CLOSED: State = ("CLOSED", 0, 0.0)


def _open(at: float) -> State:
    return ("OPEN", 0, at)  # how many failures opened it changes nothing any more


@dataclass
class Summary:
    """Where a part of a key's events leads. closed[c]: from a closed breaker with c failures. steps: from an open one, (time of an event, end) with growing times; the first late enough is the trial, and without one the breaker stays as it is."""

    closed: list[State]
    cool: float
    steps: list[tuple[float, State]] = field(default_factory=list)

    def after(self, state: State) -> State:
        mode, count, opened = state
        if mode == "CLOSED":
            return self.closed[count]
        k = bisect.bisect_left(self.steps, True, key=lambda s: s[0] - opened >= self.cool)
        return self.steps[k][1] if k < len(self.steps) else state

    def then(self, later: Summary) -> Summary:
        """One part and the part after it, as one part. This is associative."""
        steps = [(t, later.after(end)) for t, end in self.steps]
        last = self.steps[-1][0] if self.steps else -np.inf
        steps += [(t, end) for t, end in later.steps if t > last]
        return Summary([later.after(s) for s in self.closed], self.cool, _merged(steps))


def _merged(steps: list[tuple[float, State]]) -> list[tuple[float, State]]:
    out: list[tuple[float, State]] = []
    for t, end in steps:
        if out and out[-1][1] == end:
            out[-1] = (t, end)
        else:
            out.append((t, end))
    return out


def summary(now: np.ndarray, ok: np.ndarray, failures: int, cool: float) -> Summary:
    """Of events in order, worked out from the last one back."""
    n = len(now)
    # ends of a closed breaker with c failures before event i; they start as what no more event changes
    closed: list[State] = [("CLOSED", c, 0.0) for c in range(failures)]
    trial: list[State] = [CLOSED] * n  # the end if event i is the trial of an open breaker
    chain: list[int] = []  # events later than all between them and i, nearest last; their times grow towards the front

    def reopened(at: float) -> State:
        """The end of a breaker opened at a time, before the events of the chain."""
        lo, hi = 0, len(chain)
        while lo < hi:  # chain times fall towards the end: find the nearest that is late enough
            mid = (lo + hi) // 2
            if now[chain[mid]] - at >= cool:
                lo = mid + 1
            else:
                hi = mid
        return trial[chain[lo - 1]] if lo else _open(at)

    for i in range(n - 1, -1, -1):
        at = float(now[i])
        end = closed[0] if ok[i] else reopened(at)
        before = [closed[0]] * failures if ok[i] else [closed[c + 1] if c + 1 < failures else end for c in range(failures)]
        trial[i] = end
        closed = before
        while chain and now[chain[-1]] <= at:
            chain.pop()
        chain.append(i)
    steps, latest = [], -np.inf
    for i in range(n):
        if now[i] > latest:
            latest = float(now[i])
            steps.append((latest, trial[i]))
    return Summary(closed, cool, _merged(steps))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Table]]:
    """(part, key, its events in this partition) in order; the part of one key in one partition is held at a time."""
    now, kept = None, []
    for b in batches:
        part, key = b.column("part").to_pylist(), b.column("key").to_pylist()
        s = 0
        for i in range(len(part) + 1):
            if i == len(part) or i > s and (part[i], key[i]) != (part[s], key[s]):
                here = (part[s], key[s]) if len(part) else None
                if here is not None:
                    if here != now and kept:
                        yield *now, pa.Table.from_batches(kept)
                        kept = []
                    now = here
                    kept.append(b.slice(s, i - s))
                s = i
    if kept:
        yield *now, pa.Table.from_batches(kept)


def _order(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(rows["now_s"].combine_chunks(), float), np.asarray(rows["ok"].combine_chunks().fill_null(False)).astype(bool)


def breaker(events: DataFrame, failures: int = 3, cool: float = 30.0, parts: int | None = None) -> DataFrame:
    """events (key, seq, now_s, ok) in order of seq within the key: key, seq, outcome, mode, as ``limits.replay_breaker`` tells it.

    A task holds one key's events of one partition at most. Rows without a key or seq take no part; a null ok is a failure; rows that
    repeat a seq are taken in the order of now_s and ok.
    """
    spark = events.sparkSession
    folder = work_folder(spark, "runs")
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("now_s").cast("double").alias("now_s"), "ok").where("key is not null and seq is not null and now_s is not null")
    order = ["key", "seq", "now_s", "ok"]
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/events")
    placed = spark.read.schema("key string, seq long, now_s double, ok boolean, part int").parquet(f"{folder}/events")
    dealt = placed.repartition(n, "part").sortWithinPartitions("part", *order)
    # a row a partition: its first key, its last, and what a part that continues its first key does
    ends = placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()
    goes_on = {b["part"]: b["first"] for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}
    # the state that a key's last part of a partition leaves is asked for only where the next partition goes on with it
    handed = {a["part"]: a["last"] for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}

    def summaries(batches):
        for part, key, table in _runs(batches):
            if goes_on.get(part) == key or handed.get(part) == key:
                s = summary(*_order(table), failures, cool)
                states = [(c, None, *end) for c, end in enumerate(s.closed)] + [(None, t, *end) for t, end in s.steps]
                cols = list(zip(*states, strict=True))
                kinds = (pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(states), pa.int32()), pa.array([key] * len(states), pa.string()), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=["part", "key", "closed", "upto", "mode", "count", "opened"])

    wanted = sorted({*goes_on, *handed})
    found: dict[tuple[int, str], Summary] = {}
    if wanted:
        some = dealt.where(F.col("part").isin(wanted)) if len(wanted) < len(ends) else dealt
        for r in some.mapInArrow(summaries, "part int, key string, closed int, upto double, mode string, count int, opened double").orderBy("part", "closed", "upto").collect():
            s = found.setdefault((r["part"], r["key"]), Summary([], cool))
            end = (r["mode"], r["count"], r["opened"])
            if r["upto"] is None:
                s.closed.append(end)
            else:
                s.steps.append((r["upto"], end))
    begins: dict[int, State] = {}
    state = CLOSED
    for a in ends:
        part = a["part"]
        if part in goes_on:
            begins[part] = state
        if part in handed:
            # a partition of one key hands on what its beginning leads to; else its last key begins in it
            begun = begins.get(part, CLOSED) if a["first"] == a["last"] else CLOSED
            state = found[part, handed[part]].after(begun)

    def finish(batches):
        for part, key, table in _runs(batches):
            now, ok = _order(table)
            at: State | None = begins.get(part) if goes_on.get(part) == key else None
            outcome, mode = [], []
            for t, good in zip(now.tolist(), ok.tolist(), strict=True):
                at, what = breaker_step(at, t, good, failures, cool)
                outcome.append(what)
                mode.append(at[0])
            yield pa.RecordBatch.from_arrays([table["key"].combine_chunks(), table["seq"].combine_chunks(), pa.array(outcome, pa.string()), pa.array(mode, pa.string())], names=["key", "seq", "outcome", "mode"])

    return dealt.mapInArrow(finish, "key string, seq long, outcome string, mode string")
