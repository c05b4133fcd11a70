"""MinHash near-duplicate groups by an LSH forest.

A text's signature of 64 minima is read in 16 orders, each beginning with four
minima of its own. Sorted by an order, texts that share a long prefix stand
together. A region of texts sharing at least MIN_DEPTH minima is split at its
shallowest prefix until it has at most CHUNK texts, so each region gets the
depth it needs; one of equal prefixes is cut with an overlap instead. Texts of
a chunk are the candidates. They are compared on their full shingle sets and
only spanning links leave the task.

Exact copies are one class before the forest. The first orders join most near
copies; the others then ship only the chunks whose texts are not yet joined.
Two similar texts that a chunk's edge parts in every order where they share a
region are in a region larger than a chunk. So regions that still hold several
components are settled exactly. Their texts are laid in blocks of a bounded
size, similar ones and those of a large component together; two blocks are
compared where a rare shingle of a text's full set (two similar sets must share one of
so many) stands in both under different components. A block pair is a task, so
a group of any size is spread over many, and no pairs are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import textops as X
from wardline.llm.graph import components, nearest

WORDS = 5
HASHES = 64
ORDERS = 16
DEPTH = 8
MIN_DEPTH = 3
CHUNK = 32
OVERLAP = 4
FIRST_ORDERS = 2
BUCKET_BITS = 18
BLOCK_TEXTS = 1024
BLOCK_BYTES = 8 << 20

_rng = np.random.default_rng(7_919)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, end to end, and their bounds."""
    hashes, first = X.shingles(*X.word_hashes(data, off, X.NONSPACE), WORDS)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for d in range(len(first) - 1):
        hashes[first[d] : first[d + 1]].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(first) - 1))]).astype(np.int64)


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of HASHES minima for each document; zeros for an empty set."""
    out = np.zeros((len(first) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        x = (sets >> np.uint64(32)).astype(np.uint32)
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat((x ^ _FLIP[j]) * _TIMES[j], first[:-1][full])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the 128-bit hash of the set (s1, s2) and the signature (binary)."""
    X.small_batches(docs.sparkSession)

    def task(batches):
        for b in batches:
            data, off = X.column(b, "text")
            for at, to in X.slices(off):
                sets, first = shingle_sets(*X.fit(data, off, at, to))
                sig = signatures(sets, first)
                total, other = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (sets, X.mix(sets)))
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], pa.array(np.diff(first)), *(pa.array(np.diff(c[first]).view(np.int64)) for c in (total, other)), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(X.lean(task), "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def forest(classes: DataFrame, orders: int, depth: int) -> DataFrame:
    """(chunk, doc_id, tree, region) for every chunk in the sorted orders; region: the one it is a part of, 0 if the chunk is all of it.

    Rows are range-partitioned by order and prefix, so a region of any size is
    spread over tasks. A pair that a partition's edge separates in one order
    stands together in the others.
    """
    first = F.col("tree") * (HASHES // orders) * 4 + 1
    rows = classes.select("doc_id", F.concat("sig", "sig").alias("sig"), F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("tree"))
    rows = rows.select("tree", F.substr("sig", first, F.lit(depth * 4)).alias("key"), "doc_id")
    n = X.parallelism(classes.sparkSession)
    rows = rows.repartitionByRange(n, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")

    def task(batches):
        held = None
        for b in batches:
            held = b if held is None else pa.concat_batches([held, b])
            if held.num_rows < 20_000:
                continue
            cut = _last_region(held)
            if cut:
                yield _chunks(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _chunks(held)

    return rows.mapInArrow(X.lean(task), "tree int, first_doc long, doc_id long, region long").withColumn("chunk", F.struct("tree", "first_doc"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    data, off = X.column(b, "key")
    width = int(off[1] - off[0])
    return data.reshape(len(off) - 1, width).view(np.uint32)


def _shared(b: pa.RecordBatch) -> np.ndarray:
    """Prefix length that each row shares with the row before; 0 for the first."""
    m, tree = _matrix(b), np.asarray(b.column(0))
    same = np.zeros(m.shape, bool)
    same[1:] = m[1:] == m[:-1]
    depth = np.cumprod(same, axis=1).sum(1)
    depth[1:][tree[1:] != tree[:-1]] = 0
    return depth


def _last_region(b: pa.RecordBatch) -> int:
    """Where the last region begins; a region longer than the buffer is cut there."""
    starts = np.flatnonzero(_shared(b) < MIN_DEPTH)
    return int(starts[-1]) or (b.num_rows - OVERLAP if b.num_rows >= 200_000 else 0)


def _chunks(b: pa.RecordBatch) -> pa.RecordBatch:
    depth, keys = _shared(b), _matrix(b)
    docs, tree = np.asarray(b.column(2)), np.asarray(b.column(0))
    edges = np.append(np.flatnonzero(depth < MIN_DEPTH), len(depth))
    full = keys.shape[1]
    out_first, out_doc, out_tree, out_region = [], [], [], []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        large = e - s > CHUNK or s == 0 or e == len(depth)
        if e - s < 2 and not large:
            continue
        pieces = _split(depth, s, e, full)
        region = 0
        if large:  # named by its prefix, as its parts may lie in several tasks; a text between two pieces is a chunk of its own
            region = _named(tree[s], keys[s, :MIN_DEPTH])
            alone = np.ones(e - s, bool)
            for x, y in pieces:
                alone[x - s : y - s] = False
            pieces += [(x, x + 1) for x in (s + np.flatnonzero(alone)).tolist()]
        for x, y in pieces:
            out_first.append(np.full(y - x, docs[x]))
            out_doc.append(docs[x:y])
            out_tree.append(np.full(y - x, tree[x], np.int32))
            out_region.append(np.full(y - x, region))
    cat = [np.concatenate(v) if v else np.zeros(0, t) for v, t in ((out_tree, np.int32), (out_first, np.int64), (out_doc, np.int64), (out_region, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cat], names=["tree", "first_doc", "doc_id", "region"])


def _named(tree: int, prefix: np.ndarray) -> int:
    name = np.array([tree], np.uint64)
    for word in prefix.astype(np.uint64):
        name = X.mix(name + word)
    return int(name.view(np.int64)[0]) or 1


def _split(depth: np.ndarray, s: int, e: int, full: int) -> list[tuple[int, int]]:
    """Chunks of about CHUNK rows: cut where the shared prefix is shortest, evenly where it is full."""
    todo, done = [(s, e)], []
    while todo:
        s, e = todo.pop()
        low = depth[s + 1 : e].min() if e - s > CHUNK else full
        if low >= full:
            done += _even(s, e)
            continue
        cuts = [s, *(s + 1 + np.flatnonzero(depth[s + 1 : e] == low)).tolist(), e]
        run = s
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x > CHUNK:
                done += _even(run, x)
                todo.append((x, y))
                run = y
            elif y - run > CHUNK:
                done += _even(run, x)
                run = max(run + 1, x - OVERLAP)
        done += _even(run, e)
    return done


def _even(s: int, e: int) -> list[tuple[int, int]]:
    if e - s < 2:
        return []
    return [(x, min(e, x + CHUNK + OVERLAP)) for x in range(s, max(s + 1, e - OVERLAP), CHUNK)]


def links_of(sets: np.ndarray, first: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
    """Links of a chunk's documents to the first of their group; all pairs are compared on full sets."""
    n = len(first) - 1
    size = np.diff(first)
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(sets, kind="stable")
    h, d = sets[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1 if len(h) else np.zeros(0, bool)
    _, col = np.unique(group[often], return_inverse=True)
    row = d[often]
    common = np.zeros((n, n))
    width = 1 << 15
    total = int(col.max()) + 1 if len(col) else 0
    for c in range(0, total, width):
        lo, hi = np.searchsorted(col, [c, c + width])
        m = np.zeros((n, min(width, total - c)), np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    union = size[:, None] + size[None, :] - common
    linked = (100 * common >= per_cent * union) & (size[:, None] > 0) & (size[None, :] > 0)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(n) if find(i) != i]


def confirmed(chunks: DataFrame, texts: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between texts of a chunk whose full sets are similar enough."""

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        b = table.to_batches()[0]
        b = b.take(pa.compute.sort_indices(b.column("doc_id")))
        ids = np.asarray(b.column(b.schema.get_field_index("doc_id")))
        data, off = X.column(b, "text")
        parts = [shingle_sets(*X.fit(data, off, at, to)) for at, to in X.slices(off)]
        sets = np.concatenate([p[0] for p in parts])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        found = np.array(links_of(sets, first, per_cent), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return chunks.select("chunk", "doc_id").join(texts, "doc_id").groupBy("chunk").applyInArrow(task, "a long, b long")


def _unjoined(chunks: DataFrame, label: DataFrame) -> DataFrame:
    """The chunks whose texts have different labels (id, p), as (chunk, doc_id)."""
    named = chunks.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("p", F.coalesce("p", "doc_id"))
    mixed = named.groupBy("chunk").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.collect_set("doc_id").alias("docs")).where("lo < hi")
    return mixed.select("chunk", F.explode("docs").alias("doc_id"))


def _mixed(chunks: DataFrame, label: DataFrame) -> DataFrame:
    """The texts (doc_id) of large regions whose texts have different labels (id, component)."""
    parts = chunks.where("region <> 0").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    ends = parts.groupBy("region").agg(*(f(F.coalesce("component", "doc_id")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    return chunks.join(ends.where("lo < hi").select("region"), "region", "left_semi").select("doc_id").distinct()


def blocked(texts: DataFrame, heads: DataFrame, label: DataFrame, scratch: X.Scratch) -> DataFrame:
    """(doc_id, c, block, n, set): each text's component, its full set (sorted hashes) and the block it is laid in.

    Rows are sorted by signature, so similar texts share a block; a component of
    more than BLOCK_TEXTS of them has blocks of its own, which need no holding
    against each other. A block weighs BLOCK_BYTES of sets, however the rows
    are partitioned, a text counting for at least a BLOCK_TEXTS-th of that.
    """
    spark = texts.sparkSession
    rows = texts.select("doc_id", "text").join(heads.select("doc_id", "sig"), "doc_id").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rows = rows.select("doc_id", "text", F.coalesce("component", "doc_id").alias("c"), "sig")
    big = rows.groupBy("c").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_TEXTS).select("c", F.col("c").alias("own"))
    rows = rows.join(big, "c", "left").select("doc_id", "text", "c", "own", "sig")
    rows = rows.repartitionByRange(X.parallelism(spark), "own", "sig", "doc_id").sortWithinPartitions("own", "sig", "doc_id")

    def task(batches):
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            data, off = X.column(b, "text")
            for at, to in X.slices(off):
                sets, first = shingle_sets(*X.fit(data, off, at, to))
                n = np.diff(first)
                weight = np.maximum(8 * n, BLOCK_BYTES // BLOCK_TEXTS)
                place = total + np.cumsum(weight) - weight
                total += int(weight.sum())
                raw = [sets[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], b.column(2)[at:to], b.column(3)[at:to], pa.array(np.full(len(n), part)), pa.array(place), pa.array(place + weight), pa.array(n.astype(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "c", "own", "part", "place", "upto", "n", "set"])

    sets = scratch.saved(rows.mapInArrow(X.lean(task), "doc_id long, c long, own long, part long, place long, upto long, n long, set binary"))
    starts, total = [], 0
    for r in sorted(sets.groupBy("part").agg(F.max("upto").alias("upto")).collect()):  # a row for each partition
        starts.append((r["part"], total))
        total += r["upto"]
    placed = sets.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    return placed.select("doc_id", "c", F.xxhash64("own", F.floor((F.col("place") + F.col("start")) / BLOCK_BYTES)).alias("block"), "n", "set")


def _sets(b) -> tuple[np.ndarray, np.ndarray]:
    data, off = X.column(b, "set")
    return data.view(np.uint64) if data.flags.aligned and data.ctypes.data % 8 == 0 else np.frombuffer(data.tobytes(), np.uint64), off // 8


def _bucket(sets: np.ndarray) -> np.ndarray:
    return (X.mix(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles fall in each of a fixed number of buckets: the order in which ``rare_shingles`` takes them."""

    def task(batches):
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            n += np.bincount(_bucket(_sets(b)[0]), minlength=len(n))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full])], names=["bucket", "n"])

    got = sets.select("set").mapInArrow(X.lean(task), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def rare_shingles(sets: DataFrame, counts: np.ndarray, per_cent: int) -> DataFrame:
    """(shingle, doc_id, c, block, n): the first shingles of each set by (count of the bucket, hash).

    Sets that are similar enough share at least per_cent of each one's n
    shingles, so the first one they share is among so many of both.
    """

    def task(batches):
        for b in batches:
            ids, c, block = (np.asarray(b.column(i)) for i in range(3))
            got, first = _sets(b)
            for at, to in X.slices(first * 8):
                part, own = got[first[at] : first[to]], first[at : to + 1] - first[at]
                size = np.diff(own)
                doc = np.repeat(np.arange(len(size)), size)
                part = part[np.lexsort((part, counts[_bucket(part)], doc))]
                pick = np.flatnonzero(np.arange(len(part)) - own[:-1][doc] < (size - -(-size * per_cent // 100) + 1)[doc])
                d = doc[pick]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part[pick].view(np.int64), ids[at:to][d], c[at:to][d], block[at:to][d], size[d].astype(np.int64))], names=["shingle", "doc_id", "c", "block", "n"])

    return sets.select("doc_id", "c", "block", "set").mapInArrow(X.lean(task), "shingle long, doc_id long, c long, block long, n long")


def compared(table: pa.Table, per_cent: int) -> pa.Table:
    """Links (a, b) that join the components of two blocks' texts as far as any similar pair of theirs does."""
    b = table.combine_chunks().to_batches()[0]
    ids, c, block, n = (np.asarray(b.column(b.schema.get_field_index(k))) for k in ("doc_id", "c", "block", "n"))
    sets, first = _sets(b)
    order = np.argsort(sets, kind="stable")
    h = sets[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1
    _, col = np.unique(group[often], return_inverse=True)
    row = np.repeat(np.arange(len(ids)), np.diff(first))[order][often]
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    common = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    total = int(col.max()) + 1 if len(col) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(ids), min(width, total - at)), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        common += m[left] @ m[right].T
    both = common.astype(np.int64)
    similar = (100 * both >= per_cent * (n[left][:, None] + n[right][None, :] - both)) & (c[left][:, None] != c[right][None, :])
    x, y = np.nonzero(similar)
    x, y = left[x], right[y]
    pair = np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], 1)
    one = np.unique(pair, axis=0, return_index=True)[1] if len(pair) else np.zeros(0, np.int64)
    return pa.table({"a": ids[x[one]], "b": ids[y[one]]})


def exact_links(sets: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) that connect all components of ``blocked`` texts that a similar pair connects.

    For each rare shingle and block: the least and greatest component and set
    size of its texts there. A text is sent to a block pair if the other block
    holds one of its shingles under another component and near enough in size.
    """
    posts = rare_shingles(sets, bucket_counts(sets), per_cent)
    ends = posts.groupBy("shingle", "block").agg(*(f(k).alias(k + e) for k in "cn" for f, e in ((F.min, "lo"), (F.max, "hi"))))
    there = ends.groupBy("shingle").agg(F.min("clo").alias("lo"), F.max("chi").alias("hi"), F.collect_list(F.struct("block", "clo", "chi", "nlo", "nhi")).alias("others")).where("lo < hi").drop("lo", "hi")
    near = F.filter("others", lambda o: ((o["clo"] != F.col("c")) | (o["chi"] != F.col("c"))) & (o["nhi"] * 100 >= F.col("n") * per_cent) & (o["nlo"] * per_cent <= F.col("n") * 100))
    wanted = posts.join(there, "shingle").select("doc_id", "block", F.explode(F.transform(near, lambda o: o["block"])).alias("other"))
    wanted = wanted.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id").distinct()
    return wanted.join(sets, "doc_id").groupBy("x", "y").applyInArrow(lambda t: compared(t, per_cent), "a long, b long")


def _rejoined(label: DataFrame, late: DataFrame) -> DataFrame:
    """The components (id, component) with those joined that late links (a, b) connect."""
    for end in "ab":
        own = label.select(F.col("id").alias(end), F.col("component").alias("c"))
        late = late.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    joined = components(late.select("a", "b")).select(F.col("id").alias("component"), F.col("component").alias("c"))
    fresh = joined.join(label.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("c").alias("component"))
    return label.join(joined, "component", "left").select("id", F.coalesce("c", "component").alias("component")).union(fresh)


def near_duplicates(docs: DataFrame, per_cent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    A set is the text's distinct shingles of five words, the words being runs
    of anything but ASCII white space, lower-cased A-Z; a shorter text is one
    shingle; without words the set is empty and linked with nothing. Texts are
    linked at 100 * common >= per_cent * union. Null counts as empty; rows that
    repeat a doc_id are one document (the smallest text), rows without one are
    left out; equal texts are one class whatever their number. Other columns
    are ignored; an empty table gives no rows. doc_id is a whole number.
    """
    spark = docs.sparkSession
    scratch = X.Scratch(spark)
    docs = X.one_row_per_key(docs, "doc_id", "text")
    sketch = scratch.kept(sketches(docs))
    classes = sketch.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = scratch.kept(classes.where("copies > 1").drop("copies"))
    member = sketch.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    heads = sketch.join(member.where("doc_id = class_id and n_shingles > 0").select("doc_id"), "doc_id", "left_semi").select("doc_id", "sig")

    chunks = scratch.kept(forest(heads, ORDERS, DEPTH))
    texts = scratch.saved(docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi"))
    links = scratch.kept(confirmed(chunks.where(F.col("tree") < FIRST_ORDERS), texts, per_cent))
    rest = _unjoined(chunks.where(F.col("tree") >= FIRST_ORDERS), nearest(links))
    label = components(links.union(confirmed(rest, texts, per_cent)))

    apart = X.cut(_mixed(chunks, label))
    if not apart.isEmpty():
        sets = blocked(texts.join(apart, "doc_id", "left_semi"), heads, label, scratch)
        label = _rejoined(label, exact_links(sets, per_cent))

    out = member.join(label.withColumnRenamed("id", "class_id"), "class_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    out = X.cut(out.withColumn("kept", F.col("doc_id") == F.col("component_id")))
    scratch.done()
    return out


def one_of_each(docs: DataFrame, per_cent: int = 85) -> DataFrame:
    """The documents without those whose group keeps another one, all columns as they are.

    Rows that repeat a doc_id are one document and stay or go together, by the
    smallest of their texts; rows without a doc_id stay.
    """
    gone = near_duplicates(docs, per_cent).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
