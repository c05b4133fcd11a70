"""Centroid clustering by weighted deduplication.

Vectors become whole numbers floor(scale * x). Equal ones are grouped to one distinct vector with its multiplicity, and
Lloyd's rounds run on distinct vectors only: a task assigns its vectors to the nearest centroid and adds up weighted
components; Spark combines the sums, and the driver holds no more than the k centroids. At the end the assignment is
joined back to the ids.

Sums travel as limbs of 32 bits, so they are exact whatever the components weigh; numbers that a double or a long could
not hold are worked out as Python integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import textops as X

SCALE = 64
DIMS = 64
CLUSTERS = 16
ROUNDS = 3
ROWS = 4096
#: one in so many rows makes a vector hot: there can be no more hot vectors than this number
HOT_SHARE = 1000
_NEAR = 1 << 22  # components below it: squared distances of a few hundred dimensions are whole numbers of a double
_LIMB = 32
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """(vec_id, q) of the vectors that take part: floor(scale * x) as whole doubles, -0 as 0."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v * scale) < F.lit(float(1 << 52)), F.floor(v * scale).cast("double")).otherwise(v * scale)
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dims)).select("vec_id", x.alias("x")).where(F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.transform("x", whole).alias("q"))


def nearest(m: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """For each row its nearest centroid, the smaller number at a tie, and the squared distance."""
    cluster = np.zeros(len(m), np.int64)
    distance = np.zeros(len(m), object)
    small = max((abs(c) for row in centroids for c in row), default=0) < _NEAR
    near = (np.abs(m) < _NEAR).all(1) if small else np.zeros(len(m), bool)
    if near.any():
        c, v = np.array(centroids, float), m[near]
        squares = (v**2).sum(1)[:, None] - 2 * (v @ c.T) + (c**2).sum(1)[None, :]  # every term is a whole number below 2**53
        cluster[near] = squares.argmin(1)
        distance[near] = squares.min(1).astype(np.int64).astype(object)
    for i in np.flatnonzero(~near).tolist():
        row = [int(x) for x in m[i]]
        d = [sum((x - y) ** 2 for x, y in zip(row, c, strict=True)) for c in centroids]
        cluster[i] = d.index(min(d))
        distance[i] = min(d)
    return cluster, distance


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    off, values = np.asarray(column.offsets), np.asarray(column.values)
    return values[off[0] : off[-1]].reshape(-1, dims)


def _limbs(cluster: int, dim: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    sign, left, limb = (-1 if value < 0 else 1), abs(value), 0
    while left:
        yield cluster, dim, limb, sign * (left & ((1 << _LIMB) - 1))
        left >>= _LIMB
        limb += 1


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dims: int) -> Iterator[pa.RecordBatch]:
    """This task's weighted sums by cluster, as limbs; dimension ``dims`` holds the weights."""
    totals = [[0] * (dims + 1) for _ in centroids]
    for b in batches:
        m, w = _matrix(b.column(0), dims), np.asarray(b.column(1), np.int64)
        for at in range(0, len(m), ROWS):
            part, pw = m[at : at + ROWS], w[at : at + ROWS]
            cluster, _ = nearest(part, centroids)
            plain = bool((np.abs(part) < _NEAR).all() and pw.sum() < 1 << 30)
            for c in np.unique(cluster).tolist():
                on = np.flatnonzero(cluster == c)
                if plain:  # below 2**52
                    sums = (part[on] * pw[on, None]).sum(0).astype(np.int64).tolist()
                else:
                    sums = [sum(int(x) * int(n) for x, n in zip(part[on, d], pw[on], strict=True)) for d in range(dims)]
                for d, s in enumerate([*sums, int(pw[on].sum())]):
                    totals[c][d] += s
    rows = [r for c, row in enumerate(totals) for d, s in enumerate(row) for r in _limbs(c, d, s)]
    if rows:
        cluster, dim, limb, value = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], names=["cluster", "dim", "limb", "value"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dims: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = _matrix(b.column(0), dims)
        for at in range(0, len(m), ROWS):
            cluster, distance = nearest(m[at : at + ROWS], centroids)
            columns = [b.column(0).slice(at, len(cluster)), b.column(1).slice(at, len(cluster)), pa.array(cluster, pa.int32()), pa.array([min(int(d), _LONG) for d in distance], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "w", "cluster", "distance"])


def first_centroids(kept: DataFrame, k: int = CLUSTERS) -> list[list[int]]:
    """The k rows whose ids have the smallest hash, in its order; rows with one id in the order of their vectors."""
    hashed = kept.select("q", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"))
    return [[int(x) for x in r["q"]] for r in hashed.orderBy("h", "q").limit(k).collect()]


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, dims: int = DIMS) -> list[list[int]]:
    """The centroids after some rounds over (q, w): each becomes floor(sum / weight) of its vectors; one without vectors stays."""
    for _ in range(rounds):
        now = centroids
        sums = distinct.select("q", "w").mapInArrow(X.lean(lambda it, now=now: _sums(it, now, dims)), "cluster int, dim int, limb int, value long")
        totals = [[0] * (dims + 1) for _ in centroids]
        for r in sums.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():  # k * dims * a few rows
            totals[r["cluster"]][r["dim"]] += r["value"] << (_LIMB * r["limb"])
        centroids = [[s // t[dims] for s in t[:dims]] if t[dims] else c for t, c in zip(totals, centroids, strict=True)]
    return centroids


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """One row per kept vector row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, multiplicity.

    A vector is kept if it has an id and exactly ``dims`` components, none null or non-finite (nor beyond a double after
    scaling). Rows that repeat an id or a vector are rows of their own, also among the first
    centroids. Fewer than k rows give fewer centroids; equal centroids leave all vectors to the smaller number. Distances and
    inertias beyond a long are clamped. Other columns are ignored; an empty table gives no rows.

    Vectors that make up a thousandth of the rows or more, of which there can be a thousand at most, are joined back by
    broadcast, so that no task gets all rows of one; the others are joined by a shuffle.
    """
    spark = vectors.sparkSession
    X.small_batches(spark)
    scratch = X.Scratch(spark)
    kept = quantised(vectors.select("vec_id", "embedding"), scale, dims)
    centroids = first_centroids(kept, k)
    if not centroids:
        return spark.createDataFrame([], _schema(vectors))
    distinct = scratch.saved(kept.groupBy("q").agg(F.count("*").alias("w")))
    centroids = lloyd(distinct, centroids, rounds, dims)
    last = centroids
    assigned = scratch.saved(distinct.select("q", "w").mapInArrow(X.lean(lambda it: _assigned(it, last, dims)), "q array<double>, w long, cluster int, distance long"))
    scratch.done(last=1)
    exact = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("w"))
    sums = {r["cluster"]: (int(r["s"]), r["n"]) for r in assigned.groupBy("cluster").agg(exact.alias("s"), F.sum("w").alias("n")).collect()}  # k rows
    whole, rows = sum(s for s, _ in sums.values()), sum(n for _, n in sums.values())
    about = [(c, min(sums[c][0], _LONG), min(whole, _LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sums]
    told = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    hot = F.col("w") >= max(2, -(-rows // HOT_SHARE))
    often = assigned.where(hot).select("q", F.col("cluster").alias("c"), F.col("distance").alias("d"), F.col("w").alias("n"))
    met = kept.join(F.broadcast(often), "q", "left")
    back = met.where("c is null").select("vec_id", "q").join(assigned.where(~hot), "q").select("vec_id", "cluster", "distance", F.col("w").alias("multiplicity"))
    both = met.where("c is not null").select("vec_id", F.col("c").alias("cluster"), F.col("d").alias("distance"), F.col("n").alias("multiplicity")).union(back)
    return both.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "multiplicity")


def _schema(vectors: DataFrame) -> str:
    return f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, multiplicity long"
