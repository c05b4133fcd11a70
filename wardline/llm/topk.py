"""Exact top-k inner products by branch and bound over dimensions.

Vectors become integers floor(256 * x). Queries are taken in blocks of a fixed
number, each block broadcast and held against all rows. A task lays its rows
out by dimension, adds up products one block of dimensions at a time, and after
each keeps only the (query, row) pairs whose sum so far plus the bound of what
the remaining dimensions can add (the product of the remaining norms) still
reaches the query's k-th best. Each task then sends k rows a query. With more
than one block, each is a job of its own, whose k rows a task and query are
written, so neither the driver nor a worker holds more than one block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm import textops as X

SCALE = 256
BLOCK_QUERIES = 4096
BLOCK_DIMS = 16
ROWS = 2048
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of every component, as doubles; unusable vectors left out."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where("vec_id is not null and embedding is not null").select("vec_id", x.alias("x")).where(~bad).select("vec_id", F.transform("x", lambda v: F.when(F.abs(v * scale) < F.lit(float(1 << 52)), F.floor(v * scale).cast("double")).otherwise(v * scale)).alias("q"))


class Queries:
    """A block of queries by dimension, with the norms of what each block of dimensions leaves over."""

    def __init__(self, ids: list[int], vectors: list[list[float]]) -> None:
        self.ids = np.array(ids, np.int64)
        self.values = _matrix(vectors)
        self.rest = _rest(self.values)


def _matrix(vectors: list[list[float]]) -> np.ndarray:
    """Dimensions x vectors; a shorter vector counts as ending in zeros."""
    dims = max((len(v) for v in vectors), default=0)
    out = np.zeros((dims, len(vectors)))
    for k, v in enumerate(vectors):
        out[: len(v), k] = v
    return out


def _rest(m: np.ndarray) -> np.ndarray:
    """Row b: norms of the dimensions from the b-th block on; a last row of zeros."""
    squares = np.add.reduceat(m**2, np.arange(0, len(m), BLOCK_DIMS), axis=0) if len(m) else np.zeros((0, m.shape[1]))
    return np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))]))


def search(queries: Queries, ids: np.ndarray, m: np.ndarray, k: int, best: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of pairs that may be among a query's k best; best (queries x k, ascending) is brought up to date."""
    dims = max(len(m), len(queries.values))
    q, m = (np.concatenate([a, np.zeros((dims - len(a), a.shape[1]))]) for a in (queries.values, m))
    q_rest, m_rest = _rest(q), _rest(m)
    # products of components below this stay whole numbers of a double; vectors with larger ones are taken apart
    most = np.sqrt(_EXACT / max(1, dims))
    far_q, far_m = np.abs(q).max(0, initial=0) >= most, np.abs(m).max(0, initial=0) >= most
    if far_q.any() or far_m.any():
        out = [_wide(queries.ids, q, np.flatnonzero(far_q), ids, m, np.arange(m.shape[1]), k)] if far_q.any() else []
        if far_m.any():
            out.append(_wide(queries.ids, q, np.flatnonzero(~far_q), ids, m, np.flatnonzero(far_m), k))
        near, rows = np.flatnonzero(~far_q), np.flatnonzero(~far_m)
        part = best[near]
        for qi, ri, score in search(_chosen(queries, near), ids[rows], m[:, rows], k, part):
            out.append((near[qi], rows[ri], score))
        best[near] = part
        return out
    # the first block for all pairs, then pair lists
    total = q[:BLOCK_DIMS].T @ m[:BLOCK_DIMS]
    bound = total + (q_rest[1][:, None] * m_rest[1][None, :]) * (1 + 1e-12) + 1e-6
    alive = (bound >= best[:, :1]) & (queries.ids[:, None] != ids[None, :])
    qi, ri = np.nonzero(alive)
    part = total[qi, ri]
    for b in range(1, -(-dims // BLOCK_DIMS)):
        d = slice(b * BLOCK_DIMS, (b + 1) * BLOCK_DIMS)
        part = part + _dots(q[d], m[d], qi, ri)
        reach = part + q_rest[b + 1][qi] * m_rest[b + 1][ri] * (1 + 1e-12) + 1e-6
        ok = reach >= best[qi, 0]
        qi, ri, part = qi[ok], ri[ok], part[ok]
    order = np.lexsort((ids[ri], -part, qi))
    qi, ri, part = qi[order], ri[order], part[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    top = rank < k
    qi, ri, part, rank = qi[top], ri[top], part[top], rank[top]
    fresh = np.full((len(queries.ids), k), -np.inf)
    fresh[qi, rank] = part
    best[:] = np.sort(np.concatenate([best, fresh], axis=1), axis=1)[:, -k:]
    return [(qi, ri, part)]


def _dots(q: np.ndarray, m: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Products of the listed pairs: all at once while most pairs live, else pair by pair."""
    if len(qi) * 8 > q.shape[1] * m.shape[1]:
        return (q.T @ m)[qi, ri]
    out = np.zeros(len(qi))
    for a, b in zip(q, m, strict=True):
        out += a[qi] * b[ri]
    return out


def _chosen(queries: Queries, which: np.ndarray) -> Queries:
    out = Queries.__new__(Queries)
    out.ids, out.values, out.rest = queries.ids[which], queries.values[:, which], queries.rest[:, which]
    return out


def _wide(qids: np.ndarray, q: np.ndarray, which: np.ndarray, ids: np.ndarray, m: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components too large for exact doubles: whole numbers of any size, clamped to a long at the end."""
    b = [[int(x) for x in m[:, j]] for j in rows.tolist()]
    found = []
    for i in which.tolist():
        x = [int(v) for v in q[:, i]]
        scored = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), int(ids[j]), j) for j, y in zip(rows.tolist(), b, strict=True) if ids[j] != qids[i])[:k]
        found += [(i, j, max(-_LONG - 1, min(_LONG, -s))) for s, _, j in scored]
    cols = list(zip(*found, strict=True)) or [(), (), ()]
    return np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array(cols[2], object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Each query's k best rows by inner product: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    A row with the query's own id is no candidate. Null vectors, and those with
    null or non-finite components, take no part, nor do rows without an id;
    shorter vectors count as ending in zeros; a query id that repeats is asked
    once (its smallest vector), a repeated candidate row is a row of its own.
    Scores beyond a long are clamped. Other columns are ignored; empty tables
    give no rows.
    """
    spark = vectors.sparkSession
    X.small_batches(spark)
    candidates = quantised(vectors.select("vec_id", "embedding"), scale)
    asked = quantised(queries.select("vec_id", "embedding"), scale).groupBy("vec_id").agg(F.min("q").alias("q"))
    n = max(1, -(-asked.count() // block_queries))
    if n == 1:
        found = _against(candidates, asked, k)[0]
    else:
        scratch = X.Scratch(spark)
        asked = scratch.saved(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n))), "block")
        parts = []
        for block in range(n):
            part, shared = _against(candidates, asked.where(F.col("block") == block), k)
            parts.append(scratch.saved(part))
            shared.destroy()
        found = reduce(DataFrame.union, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if n > 1:  # the result alone stays, in one folder
        ranked = scratch.saved(ranked)
        scratch.done(last=1)
    return ranked


def _against(candidates: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """(query_id, vec_id, score): each task's k best rows for each query of a block, which is broadcast."""
    rows = asked.select("vec_id", "q").toArrow()
    shared = candidates.sparkSession.sparkContext.broadcast(Queries(rows["vec_id"].to_pylist(), rows["q"].to_pylist()))
    return candidates.mapInArrow(X.lean(lambda it: _task(it, shared.value, k)), "query_id long, vec_id long, score long"), shared


def _task(batches, queries: Queries, k: int):
    best = np.full((len(queries.ids), k), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in batches:
        if not len(queries.ids):
            return
        flat = b.column(1)
        off = np.asarray(flat.offsets)
        values = np.asarray(flat.values)
        size = np.diff(off)
        ids = np.asarray(b.column(0))
        if len(size) and (size == size[0]).all():
            m = values[off[0] : off[-1]].reshape(len(size), size[0]).T
        else:
            m = _matrix([values[s:e] for s, e in zip(off[:-1], off[1:], strict=True)])
        for s in range(0, m.shape[1], ROWS):
            for qi, ri, score in search(queries, ids[s : s + ROWS], m[:, s : s + ROWS], k, best):
                held.append((qi, ids[s : s + ROWS][ri], score))
        held = [_best(held, k)]
    if held:
        qi, vec, score = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[qi]), pa.array(vec), pa.array([int(s) for s in score.tolist()], pa.int64())], names=["query_id", "vec_id", "score"])


def _best(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qi, vec, score = (np.concatenate(v) for v in zip(*held, strict=True))
    if score.dtype == object:
        rows = np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -int(score[i]), vec[i])), np.int64)
    else:
        rows = np.lexsort((vec, -score, qi))
    qi, vec, score = qi[rows], vec[rows], score[rows]
    top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[top], vec[top], score[top]
