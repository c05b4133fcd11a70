"""Source divergence audit: how far the word use of each source lies from the other sources of its language.

Terms and documents are counted inside the tasks and combined by Spark. The terms that enough documents of a language
hold are range-partitioned in UTF-8 order; each partition turns its part of a language into chunks: a sorted array of
kept terms, ids by binary search in it, occurrences a source by bincount. As ids follow UTF-8 order, a chunk's
probabilities are one dense vector a source, and ties between terms are ties between ids. Pairs of sources are compared
a tile at a time (two blocks of sources in one chunk), so no task holds a whole vector, a whole language or all sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm import textops as X

SMOOTH = 5
SCALE = 1_000_000_000
LEAST_DOCS = 30
TOP = 50
CHUNK_TERMS = 4096
CHUNK_ROWS = 1 << 19
TILE_SOURCES = 64
SLICE_BYTES = 8 << 20

#: letters A to Z and every byte of a character beyond ASCII
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = True
TERM[128:] = True

_SPLIT = 31_250  # SCALE = _SPLIT * (SCALE // _SPLIT): two steps keep products of counts below 2**48 in a long


def share(count: np.ndarray, total: np.ndarray | int, terms: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact for totals below 2**48."""
    whole = np.asarray(total, np.int64) + SMOOTH * np.asarray(terms, np.int64)
    coarse = (SCALE // _SPLIT) * (np.asarray(count, np.int64) + SMOOTH)
    return 1 + _SPLIT * (coarse // whole) + _SPLIT * (coarse % whole) // whole


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n_docs, n) of every slice of documents."""
    for b in batches:
        lang, source = (b.column(k).dictionary_encode() for k in (0, 1))
        width = max(1, len(source.dictionary))
        group = np.asarray(lang.indices, np.int64) * width + np.asarray(source.indices, np.int64)
        data, off = X.column(b, "text")
        for at, to in X.slices(off, SLICE_BYTES):
            part, po = X.fit(data, off, at, to)
            starts, ends, first = X.words(part, po, TERM)
            if not len(starts):
                continue
            letters = X.lower(part[TERM[part]])
            bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
            k = len(coded.dictionary)
            doc = np.repeat(np.arange(to - at), np.diff(first))
            pair, times = np.unique(doc * k + np.asarray(coded.indices, np.int64), return_counts=True)
            key, of = np.unique(group[at:to][pair // k] * k + pair % k, return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, of, times)
            g = key // k
            columns = [lang.dictionary.take(pa.array(g // width)), source.dictionary.take(pa.array(g % width)), coded.dictionary.take(pa.array(key % k)), pa.array(np.bincount(of, minlength=len(key)).astype(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n_docs", "n"])


CODES = "lang string, part int, chunk int, n_terms int, terms array<string>, source string, ids array<int>, counts array<long>, totals array<long>"


def _encode(part: int, batches: Iterator[pa.RecordBatch], most_terms: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, n) in order, as chunks: one row with the chunk's terms, and one for each source in it."""
    chunk, held, rows = 0, [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < most_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        lang, term = (table.column(k).to_pylist() for k in (0, 1))
        end = rows  # the last term may go on in the next batch
        while end and (lang[end - 1], term[end - 1]) == (lang[-1], term[-1]):
            end -= 1
        for out in _chunks(table.slice(0, end), part, chunk, most_terms):
            chunk += 1
            yield out
        held, rows = table.slice(end).to_batches(), rows - end
    if rows:
        yield from _chunks(pa.Table.from_batches(held).combine_chunks(), part, chunk, most_terms)


def _chunks(table: pa.Table, part: int, chunk: int, most_terms: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    lang = np.array(table.column(0).to_pylist(), object)
    term = np.array([t.encode() for t in table.column(1).to_pylist()], object)
    turns = np.flatnonzero(np.concatenate([[True], lang[1:] != lang[:-1]]))
    for s, e in zip(turns.tolist(), [*turns[1:].tolist(), len(lang)], strict=True):
        own = term[s:e]
        kept = own[np.concatenate([[True], own[1:] != own[:-1]])]  # sorted by their bytes
        for c in range(0, len(kept), most_terms):
            terms = kept[c : c + most_terms]
            lo, hi = np.searchsorted(own, terms[0], "left"), np.searchsorted(own, terms[-1], "right")
            rows = table.slice(s + int(lo), int(hi - lo))
            ids = np.searchsorted(terms, own[lo:hi])
            coded = rows.column(2).combine_chunks().dictionary_encode()
            source, k = np.asarray(coded.indices, np.int64), len(terms)
            # whole numbers of a double up to 2**53
            dense = np.bincount(source * k + ids, weights=np.asarray(rows.column(3)), minlength=len(coded.dictionary) * k).astype(np.int64).reshape(-1, k)
            totals = dense.sum(0)
            used = [np.flatnonzero(row) for row in dense]
            n = 1 + len(used)
            columns = [
                [lang[s]] * n, [part] * n, [chunk] * n, [k] * n, [[t.decode() for t in terms], *[None] * (n - 1)], [None, *coded.dictionary.to_pylist()],
                [None, *used], [None, *[row[u] for row, u in zip(dense, used, strict=True)]], [None, *[totals[u] for u in used]],
            ]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["lang", "part", "chunk", "n_terms", "terms", "source", "ids", "counts", "totals"])
            chunk += 1


def _lists(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    a = b.column(k)
    off, values = np.asarray(a.offsets), np.asarray(a.values)
    return [values[s:e] for s, e in zip(off[:-1], off[1:], strict=True)]


def _rises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's best terms by how far the source's share lies above the language's."""
    for b in batches:
        n, n_lang, v = (np.asarray(b.column(k)) for k in (7, 8, 9))
        row, ident, value = [], [], []
        for i, (ids, counts, totals) in enumerate(zip(_lists(b, 4), _lists(b, 5), _lists(b, 6), strict=True)):
            f = share(counts, n[i], v[i]) - share(totals, n_lang[i], v[i])
            up = np.flatnonzero(f > 0)
            best = up[np.lexsort((ids[up], -f[up]))][:TOP]
            row += [i] * len(best)
            ident += ids[best].tolist()
            value += f[best].tolist()
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(4)), pa.array(ident, pa.int32()), pa.array(value, pa.int64())], names=["lang", "source", "part", "chunk", "id", "value"])


def _tile(table: pa.Table, tile: int) -> pa.Table:
    """Sums of differences over a chunk, for the pairs of sources x < y of two blocks."""
    lang, a, b, k, v = (table.column(c)[0].as_py() for c in ("lang", "a", "b", "n_terms", "v"))
    rows = table.combine_chunks()
    gid, n = np.asarray(rows.column("gid")), np.asarray(rows.column("n"))
    dense = np.zeros((len(gid), k), np.int64)
    for i, (ids, counts) in enumerate(zip(rows.column("ids").to_pylist(), rows.column("counts").to_pylist(), strict=True)):
        if ids:
            dense[i, ids] = counts
    p = share(dense, n[:, None], v) if k else dense
    left, right = np.flatnonzero(gid // tile == a), np.flatnonzero(gid // tile == b)
    xs, ys, sums = [], [], []
    for i in left.tolist():
        on = right[gid[right] > gid[i]]
        xs.append(np.full(len(on), gid[i]))
        ys.append(gid[on])
        sums.append(np.abs(p[on] - p[i]).sum(1))
    cat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    xs = cat(xs)
    return pa.table({"lang": pa.array([lang] * len(xs), pa.string()), "x": xs, "y": cat(ys), "value": cat(sums)})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, chunk_terms: int = CHUNK_TERMS, chunk_rows: int = CHUNK_ROWS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """Per (lang, source) group: every other source of the language by the distance of their word shares, and the 50 terms that rise most over the language.

    Columns lang, source, part (``pair`` or ``term``), item, value, rank. Null text, lang and source read as empty. Every
    row is a document, so a repeated row counts again; texts of any length are read whole; other columns are ignored. A group
    without kept terms has the smoothed shares of an empty one and is paired like the others; in a language without kept
    terms all pairs have the value 0. Ties go to the smaller item in UTF-8 order. An empty table gives no rows. Counts are exact
    up to 2**48 occurrences a language. A chunk ends at ``chunk_terms`` terms or ``chunk_rows`` rows, a tile holds two blocks of ``tile_sources`` sources.
    """
    spark = docs.sparkSession
    X.small_batches(spark)
    scratch = X.Scratch(spark)
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    seen = named.mapInArrow(X.lean(_count), "lang string, source string, term string, n_docs long, n long")
    counted = seen.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    kept = scratch.saved(counted.withColumn("df", F.sum("n_docs").over(Window.partitionBy("lang", "term"))).where(F.col("df") >= least_docs).select("lang", "term", "source", "n"))
    ordered = kept.repartitionByRange(X.parallelism(spark), "lang", "term").sortWithinPartitions("lang", "term", "source")

    def encode(batches):
        from pyspark import TaskContext

        return _encode(TaskContext.get().partitionId(), batches, chunk_terms, chunk_rows)

    codes = scratch.saved(ordered.mapInArrow(X.lean(encode), CODES))
    scratch.done(last=1)
    chunks, used = codes.where("source is null"), codes.where("source is not null")
    sizes = chunks.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    sums = used.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    number = Window.partitionBy("lang").orderBy("source")
    groups = (
        named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), (F.row_number().over(number) - 1).cast("long").alias("gid"), F.count("*").over(Window.partitionBy("lang")).alias("s"), F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("lang")).alias("n_lang"))
    )
    groups = scratch.saved(groups)
    parts = _pairs(groups, chunks, used, tile_sources).unionByName(_terms(groups, chunks, used))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return parts.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def _terms(groups: DataFrame, chunks: DataFrame, used: DataFrame) -> DataFrame:
    rows = used.join(groups, ["lang", "source"]).select("lang", "source", "part", "chunk", "ids", "counts", "totals", "n", "n_lang", "v")
    rises = rows.mapInArrow(X.lean(_rises), "lang string, source string, part int, chunk int, id int, value long")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "part", "chunk", "id")
    top = rises.withColumn("r", F.row_number().over(best)).where(F.col("r") <= TOP)
    named = top.join(chunks.select("lang", "part", "chunk", "terms"), ["lang", "part", "chunk"])
    return named.select("lang", "source", F.lit("term").alias("part"), F.element_at("terms", F.col("id") + 1).alias("item"), "value")


def _pairs(groups: DataFrame, chunks: DataFrame, used: DataFrame, tile: int) -> DataFrame:
    none = groups.where("v = 0").select("lang", F.lit(-1).alias("part"), F.lit(0).alias("chunk"), F.lit(0).alias("n_terms")).distinct()
    places = chunks.select("lang", "part", "chunk", "n_terms").union(none)
    vectors = groups.join(places, "lang").join(used.select("lang", "part", "chunk", "source", "ids", "counts"), ["lang", "part", "chunk", "source"], "left")
    block = F.expr(f"int(gid div {tile})")
    others = F.sequence(F.lit(0), F.expr(f"int((s - 1) div {tile})"))
    tiles = vectors.withColumn("tile", F.explode(F.transform(others, lambda o: F.struct(F.least(block, o).alias("a"), F.greatest(block, o).alias("b")))))
    tiles = tiles.select("lang", "part", "chunk", "tile.a", "tile.b", "n_terms", "gid", "n", "v", "ids", "counts")
    sums = tiles.groupBy("lang", "part", "chunk", "a", "b").applyInArrow(lambda t: _tile(t, tile), "lang string, x long, y long, value long")
    pairs = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("x").alias("g"), F.col("y").alias("h")), F.struct(F.col("y").alias("g"), F.col("x").alias("h")))).alias("e")).select("lang", "value", "e.g", "e.h")
    own, other = groups.select("lang", F.col("gid").alias("g"), "source"), groups.select("lang", F.col("gid").alias("h"), F.col("source").alias("item"))
    return both.join(own, ["lang", "g"]).join(other, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
