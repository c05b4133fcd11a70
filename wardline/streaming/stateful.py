"""Streams with state of their own: a semantic cache, a vault whose values die, and reviews whose tokens serve once.

Each is a plain step over (state, event), which the tests fold in order, and a processor that keeps the state between
batches. Rows of a key are taken in order of seq; a batch holds all rows of its keys up to its end.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these processors need, while a query is started."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _ordered(rows: Iterator[pd.DataFrame]) -> list[dict[str, Any]]:
    """A key's rows in order of seq; what pandas shows as missing is None again."""
    table = pd.concat(list(rows)).sort_values("seq", kind="stable")
    return [{k: None if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v) else v for k, v in r.items()} for r in table.to_dict("records")]


# the semantic cache

#: fixed value: similarity from which a cached answer serves
CACHE_THRESHOLD = 0.92
CACHE_CAPACITY = 1000
_ENTRY = "request_id string, vector array<double>, response string"
CACHE_OUT = "tenant string, seq long, request_id string, outcome string, similarity double, response string"


def admitted(action: str | None, categories: Any) -> bool:
    """Whether a request may read and fill the cache: no warning, no block, no secret in it."""
    return (action or "").lower() not in ("warn", "block") and not any(str(c).startswith("SECRET") for c in (categories if categories is not None else ()))


def unit(vector: Any) -> np.ndarray | None:
    """The vector at unit length; None for null, empty, zero and broken ones."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return None
    v = np.asarray(vector, float)
    n = float(np.sqrt((v * v).sum()))
    return v / n if np.isfinite(n) and n > 0 else None


class Entries:
    """A tenant's cached answers in a ring of slots: the oldest gives way. ``changed`` are the slots written since it was loaded."""

    def __init__(self, capacity: int, stored: int = 0, slots: dict[int, tuple[str, np.ndarray, str | None]] | None = None) -> None:
        self.capacity, self.stored, self.slots = capacity, stored, slots or {}
        self.changed: set[int] = set()

    def look_up(self, v: np.ndarray) -> tuple[float, int] | None:
        """(similarity to six digits, slot) of the nearest entry of the same length; the one stored first at a tie."""
        best = None
        for n in range(max(0, self.stored - self.capacity), self.stored):
            _, w, _ = self.slots[n % self.capacity]
            if len(w) == len(v):
                s = round(float(v @ w), 6)
                if best is None or s > best[0]:
                    best = (s, n % self.capacity)
        return best

    def store(self, request: str, v: np.ndarray, response: str | None) -> None:
        slot = self.stored % self.capacity
        self.slots[slot] = (request, v, response)
        self.changed.add(slot)
        self.stored += 1


def cache_step(entries: Entries, event: dict[str, Any], threshold: float) -> tuple[str, float | None, str | None]:
    """(outcome, similarity, answer): ``bypass`` beside the gate, ``hit`` with the stored answer, else ``stored`` (or ``miss`` without an answer to store). The look-up comes before the store."""
    v = unit(event["embedding"])
    if v is None or not admitted(event["action"], event["categories"]):
        return "bypass", None, None
    best = entries.look_up(v)
    if best and best[0] >= threshold:
        return "hit", best[0], entries.slots[best[1]][2]
    if event["response"] is None:
        return "miss", None, None
    entries.store(event["request_id"], v, event["response"])
    return "stored", None, None


def cache_stream(requests: DataFrame, threshold: float = CACHE_THRESHOLD, capacity: int = CACHE_CAPACITY) -> DataFrame:
    """requests (tenant, guards, seq, request_id, action, categories, embedding, response): what the cache did with each.

    An answer serves only requests of its tenant whose guards are equal, so the state is kept by both: a large tenant is
    spread by its guards. A null guard is the empty one. A key keeps at most ``capacity`` answers.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Cache(StatefulProcessor):
        def init(self, handle) -> None:
            self.slots = handle.getMapState("slots", "slot int", _ENTRY)
            self.stored = handle.getValueState("stored", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n = int(self.stored.get()[0]) if self.stored.exists() else 0
            held = {int(k[0]): (v[0], np.asarray(v[1], float), v[2]) for k, v in self.slots.iterator()}
            entries, out = Entries(capacity, n, held), []
            for e in _ordered(rows):
                out.append((key[0], e["seq"], e["request_id"], *cache_step(entries, e, threshold)))
            for slot in sorted(entries.changed):
                request, v, response = entries.slots[slot]
                self.slots.updateValue((slot,), (request, v.tolist(), response))
            self.stored.update((entries.stored,))
            yield pd.DataFrame(out, columns=["tenant", "seq", "request_id", "outcome", "similarity", "response"])

        def close(self) -> None:
            pass

    columns = ["tenant", "guards", "seq", "request_id", "action", "categories", "embedding", "response"]
    keyed = requests.withColumn("guards", F.coalesce("guards", F.lit(""))).select(*columns).where("tenant is not null").groupBy("tenant", "guards")
    return keyed.transformWithStateInPandas(statefulProcessor=Cache(), outputStructType=CACHE_OUT, outputMode="Append", timeMode="None")


# the vault

VAULT_OUT = "request_id string, seq long, placeholder string, value string"


def vault_stream(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """events (request_id, seq, ts, op, placeholder, value) of puts and gets: the value that each get is given, null if there is none any more.

    A value lives ``seconds`` from its put; a later put of the same placeholder begins a new life. The answer depends on the times of
    the events alone. The state is kept no longer: when the watermark (the newest time less ``late``) passes the end of a life, a
    timer removes the value.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Vault(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.values = handle.getMapState("values", "placeholder string", "value string, ends long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            out = []
            for e in _ordered(rows):
                name, now = (e["placeholder"],), int(pd.Timestamp(e["ts"]).value // 1_000_000)
                if e["op"] == "put":
                    ends = now + 1000 * seconds
                    self.values.updateValue(name, (e["value"], ends))
                    self.handle.registerTimer(ends)
                else:
                    held = self.values.getValue(name) if self.values.containsKey(name) else None
                    out.append((key[0], e["seq"], name[0], held[0] if held is not None and now < held[1] else None))
            yield pd.DataFrame(out, columns=["request_id", "seq", "placeholder", "value"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            at = expiredTimerInfo.getExpiryTimeInMs()
            for name, held in list(self.values.iterator()):
                if held[1] <= at:
                    self.values.removeKey(tuple(name))
            yield pd.DataFrame([], columns=["request_id", "seq", "placeholder", "value"])

        def close(self) -> None:
            pass

    timed = events.select("request_id", "seq", "ts", "op", "placeholder", "value").withWatermark("ts", late)
    return timed.groupBy("request_id").transformWithStateInPandas(statefulProcessor=Vault(), outputStructType=VAULT_OUT, outputMode="Append", timeMode="EventTime")


# reviews

_REVIEW = "last_seq long, status string, token_hash string, expires long, used boolean"
REVIEW_OUT = "request_id string, seq long, outcome string, status string"


def review_step(state: dict[str, Any], event: str, token: str | None, now: int, seconds: int) -> str:
    """What came of an event (open, approve, deny, use) of a request's review; the state is brought up to date. now in milliseconds."""
    status = state["status"]
    if event == "open":
        if status == "PENDING":
            return "already_pending"
        state.update(status="PENDING", token_hash=None, expires=None, used=False)
        return "opened"
    if event == "use":
        if status != "APPROVED":
            return "not_approved"
        if token != state["token_hash"]:
            return "unknown"
        if state["used"]:
            return "already_used"
        if state["expires"] < now:
            return "expired"
        state["used"] = True
        return "used"
    if status != "PENDING":
        return "not_pending"
    if event == "approve":
        state.update(status="APPROVED", token_hash=token, expires=now + 1000 * seconds, used=False)
        return "approved"
    state.update(status="DENIED")
    return "denied"


def review_stream(events: DataFrame, seconds: int) -> DataFrame:
    """events (request_id, seq, ts, event, token_hash): what came of each, and the review's state after it, as ``audit.review_states`` tells it of a whole table.

    An event at or before the last seq of its request has been dealt with and gives no row, so a token serves once however
    often its use is told. An approval without a token can be used by nobody.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Reviews(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("review", _REVIEW)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            names = ("last_seq", "status", "token_hash", "expires", "used")
            state = dict(zip(names, self.state.get() if self.state.exists() else (None, None, None, None, False), strict=True))
            out = []
            for e in _ordered(rows):
                if state["last_seq"] is not None and e["seq"] <= state["last_seq"]:
                    continue
                what = review_step(state, e["event"], e["token_hash"], int(pd.Timestamp(e["ts"]).value // 1_000_000), seconds)
                state["last_seq"] = e["seq"]
                out.append((key[0], e["seq"], what, state["status"]))
            self.state.update(tuple(state[n] for n in names))
            yield pd.DataFrame(out, columns=["request_id", "seq", "outcome", "status"])

        def close(self) -> None:
            pass

    rows = events.select(F.col("request_id").cast("string").alias("request_id"), "seq", "ts", "event", "token_hash")
    return rows.groupBy("request_id").transformWithStateInPandas(statefulProcessor=Reviews(), outputStructType=REVIEW_OUT, outputMode="Update", timeMode="None")
