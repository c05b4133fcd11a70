"""Exact nearest neighbours by cosine within a tenant, without comparing all pairs.

Vectors get unit length, so cosine order is the order of distances, and distances obey the triangle inequality. A tenant's
entries go to the nearest of some pivots; within a pivot's cell they are range-partitioned by their distance to it and
cut into rings. For a probe at known distances from the pivots, no entry of a ring can be nearer than

* what the ring's least and greatest distance leave (|probe - pivot| less the ring), and
* half of how much farther the ring's pivot is than the probe's nearest one.

A first pass looks into the rings that promise most, until they hold k entries. Its k-th similarity, or the threshold, is the bound of
a second pass, which looks only into rings that can still hold something better. Pairs are computed as matrix products in a
task: a ring's entries are held, the probes that look into it are streamed past them.

The number of rings, and the size of one, grow with the square root of a tenant's entries. Keys that hold a thousandth of
a table or more (there can be a thousand at most, which bounds what is collected and broadcast) are salted by their size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.session import work_folder

PIVOTS = 64
RING = 256
HOT_SHARE = 1000
#: a table of so many rows is one task's work if need be
UNSALTED = 100_000
DIGITS = 6
_TIE = 1e-6  # similarities are rounded to six digits, so what lies so near to the k-th may tie with it
_SLACK = 1e-6  # of distances worked out in doubles


# held rows and streamed rows of one key


def _salts(rows: DataFrame, *key: str) -> dict[tuple, int]:
    """Keys that hold a thousandth of the rows or more, with their share in thousandths; none in a table of few rows."""
    whole = rows.count()
    if whole <= UNSALTED:
        return {}
    least = math.ceil(whole / HOT_SHARE)
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return {tuple(r[k] for k in key): math.ceil(r["n"] / least) for r in counts.where(F.col("n") >= least).collect()}


def _beside(held: DataFrame, streamed: DataFrame, key: list[str], by: str, hot: dict[tuple, int], prepare: Callable[[pa.Table], Any], step: Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """step(prepare(held rows of a key), a batch of its streamed rows), for every key of both; a hot key's streamed rows are dealt over copies of its held ones."""
    spark = held.sparkSession
    salts = F.broadcast(spark.createDataFrame([(*k, n) for k, n in hot.items()], held.select(*key, F.lit(1).alias("salts")).schema))
    many = F.coalesce("salts", F.lit(1))
    a = held.join(salts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).withColumn("side", F.lit(0)).drop("salts")
    b = streamed.join(salts, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), many).cast("int")).withColumn("side", F.lit(1)).drop("salts")
    both = a.unionByName(b, allowMissingColumns=True)
    names = both.columns
    runs = [names.index(c) for c in (*key, "salt", "side")]
    dealt = both.repartition(*key, "salt").sortWithinPartitions(*key, "salt", "side")

    def task(batches):
        now, kept, ready = None, [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in runs:
                col = batch.column(c)
                new[1:] |= np.asarray(pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, n - 1)), True))
            at = np.flatnonzero(new).tolist()
            for s, e in zip(at, [*at[1:], n], strict=True):
                *here, side = (batch.column(c)[s].as_py() for c in runs)
                if here != now:
                    now, kept, ready = here, [], None
                part = batch.slice(s, e - s)
                if not side:
                    kept.append(part)
                elif kept:
                    ready = prepare(pa.Table.from_batches(kept)) if ready is None else ready
                    yield from step(ready, part)

    return dealt.mapInArrow(task, out)


def _column(rows: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = rows.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _matrix(rows: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    a = _column(rows, name)
    off, values = np.asarray(a.offsets), np.asarray(a.values)
    return values[off[0] : off[-1]].reshape(len(a), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


# cells and rings


def _unit(vector: str) -> tuple[Column, Column]:
    """The vector at unit length; whether it takes part: no null or non-finite component, not all zeros."""
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (norm > 0) & (norm < float("inf")), F.lit(False))
    return F.transform(x, lambda v: v / norm), good


def _grouped(rows: DataFrame, ident: str, also: list[str]) -> DataFrame:
    """(g, id, v): what a probe and an entry must have in common as one text, the id, the unit vector."""
    unit, good = _unit("embedding")
    there = F.col("tenant").isNotNull() & F.col(ident).isNotNull()
    for c in also:
        there &= F.col(c).isNotNull()
    common = F.to_json(F.struct("tenant", *also, F.size("embedding").alias("dims")))
    return rows.where(there & good).select(common.alias("g"), F.col(ident).alias("id"), unit.alias("v"))


def _assign(pivots: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    m = _matrix(batch)
    d = _distances(m, pivots)
    cell = d.argmin(1)
    yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=["g", "id", "v", "cell", "r"])


def _rings(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the ring's number: rows come by group, cell and distance; a ring ends with its cell or when it is full."""
    ring, last, held = (part << 32) - 1, None, 0
    for b in batches:
        out = []
        for g, cell, size in zip(b.column("g").to_pylist(), b.column("cell").to_pylist(), b.column("size").to_pylist(), strict=True):
            if (g, cell) != last or held >= size:
                ring, last, held = ring + 1, (g, cell), 0
            held += 1
            out.append(ring)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("g", "id", "v", "cell", "r")), pa.array(out, pa.int64())], names=["g", "id", "v", "cell", "r", "ring"])


class _Map:
    """The pivots and rings of a group."""

    def __init__(self, rows: pa.Table) -> None:
        kind = np.asarray(_column(rows, "ring")) < 0
        pivots = rows.filter(pa.array(kind))
        order = np.argsort(np.asarray(_column(pivots, "cell")))
        self.pivots = _matrix(pivots.take(pa.array(order)))
        rings = rows.filter(pa.array(~kind))
        self.ring, self.cell, self.n = (np.asarray(_column(rings, c)) for c in ("ring", "cell", "n"))
        self.low, self.high = (np.asarray(_column(rings, c)) for c in ("low", "high"))

    def bounds(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probes x rings) the least distance an entry of the ring can have, and the distance of its pivot."""
        d = _distances(probes, self.pivots)
        own = d[:, self.cell]
        least = np.maximum(np.maximum(own - self.high, self.low - own), (own - d.min(1)[:, None]) / 2)
        return np.maximum(least, 0.0), own


def _first_looks(k: int, reach: float) -> Callable:
    """The most promising rings of each probe, until they hold k entries."""

    def step(at: _Map, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            least, own = at.bounds(_matrix(part))
            row, ring = [], []
            for i in range(len(least)):
                order = np.lexsort((own[i], least[i]))
                order = order[least[i][order] <= reach]
                enough = int(np.searchsorted(np.cumsum(at.n[order]), k)) + 1
                row += [i] * len(order[:enough])
                ring += at.ring[order[:enough]].tolist()
            yield _looks(part, row, ring)

    return step


def _other_looks(batch_at: _Map, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rings that can still hold something as good as the probe's bound, without those it has looked into."""
    for s in range(0, batch.num_rows, 256):
        part = batch.slice(s, 256)
        least, _ = batch_at.bounds(_matrix(part))
        reach = np.sqrt(np.maximum(0.0, 2 - 2 * (np.asarray(part.column("bound")) - _TIE))) + _SLACK
        open_ = least <= reach[:, None]
        for i, seen in enumerate(part.column("seen").to_pylist()):
            open_[i] &= ~np.isin(batch_at.ring, seen)
        row, ring = np.nonzero(open_)
        yield _looks(part, row, batch_at.ring[ring])


def _looks(part: pa.RecordBatch, row, ring) -> pa.RecordBatch:
    at = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("v").take(at), pa.array(ring, pa.int64())], names=["id", "v", "ring"])


def _compare(k: int, threshold: float) -> Callable:
    """Each probe's k best entries of the ring by rounded similarity, ties to the smaller id."""

    def step(held: tuple[pa.Array, np.ndarray, int], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, entries, ring = held
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            sim = np.rint(_matrix(part) @ entries.T * 10**DIGITS) / 10**DIGITS
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(sim)), best.shape[1])
            col = best.ravel()
            ok = sim[row, col] >= threshold
            row, col = row[ok], col[ok]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), ids.take(pa.array(col)), pa.array(sim[row, col])], names=["probe_id", "entry_id", "similarity"])

    return step


def _ring_rows(rows: pa.Table) -> tuple[pa.Array, np.ndarray, int]:
    rows = rows.sort_by("id")
    return _column(rows, "id"), _matrix(rows), rows.num_rows


class Index:
    """Entries in rings, kept in the shared folder; it serves any number of searches by the same k or a smaller one."""

    def __init__(self, entries: DataFrame, also: list[str] | None = None, k: int = 1, pivots: int = PIVOTS, ring: int = RING) -> None:
        """entries: entry_id, tenant, embedding, and the columns ``also`` that a probe must have equal. Of equal vectors the k smallest ids are kept: no others can be among a probe's k best."""
        spark = entries.sparkSession
        self.k, self.also = k, also or []
        self._folder = work_folder(spark, "neighbours")
        rows = _grouped(entries, "entry_id", self.also)
        self._kind = rows.schema["id"].dataType.simpleString()
        first = Window.partitionBy("g", "v").orderBy("id")
        kept = self._saved("entries", rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k).drop("copy"))
        sizes = kept.groupBy("g").agg(F.count("*").alias("n"))
        sizes = self._saved("sizes", sizes.select("g", F.greatest(F.lit(ring), F.ceil(F.sqrt("n"))).cast("int").alias("size"), F.least(F.lit(pivots), F.ceil(F.col("n") / ring)).cast("int").alias("pivots")))
        drawn = kept.withColumn("cell", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id"), "id")) - 1).where(F.col("cell") < pivots)
        self._pivots = self._saved("pivots", drawn.join(sizes, "g").where(F.col("cell") < F.col("pivots")).select("g", "cell", "v", "size"))
        hot = _salts(kept, "g")
        assigned = self._saved("cells", _beside(self._pivots.drop("size"), kept, ["g"], "id", hot, _pivot_rows, _assign, f"g string, id {self._kind}, v array<double>, cell int, r double"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        ordered = assigned.join(self._pivots.select("g", "cell", "size"), ["g", "cell"]).repartitionByRange(parts, "g", "cell", "r", "id").sortWithinPartitions("g", "cell", "r", "id")

        def cut(batches):
            from pyspark import TaskContext

            return _rings(TaskContext.get().partitionId(), batches)

        self._entries = self._saved("rings", ordered.select("g", "id", "v", "cell", "r", "size").mapInArrow(cut, f"g string, id {self._kind}, v array<double>, cell int, r double, ring long"))
        bounds = self._entries.groupBy("g", "cell", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
        self.rings = self._saved("bounds", bounds)

    def _saved(self, name: str, df: DataFrame) -> DataFrame:
        to = f"{self._folder}/{name}"
        df.write.parquet(to)
        return df.sparkSession.read.schema(df.schema).parquet(to)

    def _map(self) -> DataFrame:
        return self._pivots.select("g", "cell", "v", F.lit(-1).cast("long").alias("ring")).unionByName(self.rings, allowMissingColumns=True)

    def _found(self, looks: DataFrame, threshold: float, probe_kind: str) -> DataFrame:
        hot = _salts(looks, "ring")
        return _beside(self._entries.select("ring", "id", "v"), looks.select("ring", F.col("id").alias("probe"), "v"), ["ring"], "probe", hot, _ring_rows, _compare_probes(self.k, threshold), f"probe_id {probe_kind}, entry_id {self._kind}, similarity double")

    def search(self, probes: DataFrame, threshold: float, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(probe_id, entry_id, similarity, rank) of each probe's k best entries at or over the threshold, and (id, ring) of all rings looked into.

        A probe id names one probe: of rows that repeat it, the smallest vector. Similarities are rounded to six digits; ties go to the smaller
        entry id. Vectors that are null, all zeros, or hold null or non-finite components take no part, nor rows without tenant or id.
        """
        k = k or self.k
        if k > self.k:
            raise ValueError(f"this index keeps {self.k} copies of a vector")
        asked = _grouped(probes, "probe_id", self.also)
        kind = asked.schema["id"].dataType.simpleString()
        asked = self._saved(f"asked-{id(probes)}", asked.groupBy("id").agg(F.min(F.struct("g", "v")).alias("x")).select("x.g", "id", "x.v"))
        hot = _salts(asked, "g")
        reach = math.sqrt(max(0.0, 2 - 2 * (threshold - _TIE))) + _SLACK
        looks = f"id {kind}, v array<double>, ring long"
        first = self._saved(f"first-{id(probes)}", _beside(self._map(), asked, ["g"], "id", hot, _Map, _first_looks(k, reach), looks))
        near = self._saved(f"near-{id(probes)}", self._found(first, threshold, kind))
        best = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "entry_id")
        kth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("probe_id").alias("id"), F.col("similarity").alias("kth"))
        seen = first.groupBy("id").agg(F.collect_list("ring").alias("seen"))
        bounded = asked.join(seen, "id").join(kth, "id", "left").select("g", "id", "v", "seen", F.greatest(F.coalesce("kth", F.lit(threshold)), F.lit(float(threshold))).alias("bound"))
        other = self._saved(f"other-{id(probes)}", _beside(self._map(), bounded, ["g"], "id", hot, _Map, _other_looks, looks))
        both = near.union(self._found(other, threshold, kind))
        ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("probe_id", "entry_id", "similarity", "rank"), first.select("id", "ring").union(other.select("id", "ring"))


def _pivot_rows(rows: pa.Table) -> np.ndarray:
    return _matrix(rows.sort_by("cell"))


def _compare_probes(k: int, threshold: float) -> Callable:
    step = _compare(k, threshold)

    def of(held, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return step(held, pa.RecordBatch.from_arrays([batch.column("probe"), batch.column("v")], names=["id", "v"]))

    return of


def nearest(probes: DataFrame, entries: DataFrame, threshold: float, k: int = 1, pivots: int = PIVOTS, ring: int = RING) -> DataFrame:
    """Each probe's k best entries of its own tenant at or over the threshold; see ``Index.search``.

    probes: probe_id, tenant, embedding and, if the entries have them too, guards, which must then be equal; entries: entry_id, tenant, embedding.
    """
    also = ["guards"] if "guards" in probes.columns and "guards" in entries.columns else []
    return Index(entries, also, k, pivots, ring).search(probes, threshold)[0]
