"""Repeated byte strings over all documents, by induced sorting of anchored suffixes.

Every 100-byte window has an anchor: its 32-byte gram of least hash, the
leftmost one. Equal windows have equal anchors at equal offsets, so windows
need comparing only under one anchor, and the suffixes at anchors are the
sample that order is induced from:

1. Each task finds the anchors of its texts and, for each, the stretch of text
   covered by the windows anchored there. Copies of a stretch within the task
   are settled at once; a tuple of two hashes and the place goes to the
   anchor's shard (shuffle files on disk hold them; a shard has a fixed size).
2. A shard sorts its tuples. All but the first copy of a stretch are repeats.
   Anchors with different stretches ask for the bytes of one copy of each.
3. Those suffixes are sorted with their common-prefix values; then the order
   at offset o+1 is induced from that at offset o by one stable pass over the
   byte before, the common prefix growing by one where bytes agree and
   otherwise taking the least value between. Windows with a common prefix of
   100 are equal; all but the first are repeats.

An anchor with very many different stretches would crowd its shard. Such anchors
are found beforehand on a sample of the documents; they send two hashes per
window instead, spread over all shards by the first. Nothing is dropped, and
both ways give the same result.

Step 1 tells stretches, and hot anchors' windows, apart by 96 bits of two
hashes: over n of them a mistake anywhere has a chance near n * n / 2 ** 97
(6e-5 for the 3e12 stretches of 100 TB). Step 3 compares bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import textops as X

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM  # most bytes of a window before its anchor
SHARD_TEXT = 24 << 20
FLUSH = 400_000
#: an anchor is hot from this many different stretches on, or from the number of shards if that is more; one document in SAMPLE is looked at
HOT = 50_000
SAMPLE = 64
SEGMENT = 4 << 20
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)

_TUPLE = "shard int, n long, ah binary, ch binary, doc binary, p1 binary, xo binary, span binary, kind binary"
_DONE, _ASK, _WINDOW = 0, 1, 2
_REC = np.dtype([("p1", "<i4"), ("span", "u1"), ("xo", "u1"), ("kind", "u1"), ("ah", "<u8")])


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, anchor offset, windows - 1, anchor hash, stretch hash) of all anchors; places count from the document's start."""
    n = len(data)
    size = np.diff(off)
    starts = X.ragged(off[:-1], np.maximum(0, size - LENGTH + 1))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    c = X.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = X.range_hash(c, at, at + GRAM)
    least = (gram & ~_PLACE) | at.astype(np.uint64)
    width = 1
    while width * 2 <= LEFT + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LEFT + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    x = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(x)) - 1
    p1, p2, x = starts[begin], starts[end], x[begin]
    doc = np.searchsorted(off, p1, "right") - 1
    stretch = X.mix(X.range_hash(c, p1, p2 + LENGTH) + (x - p1).astype(np.uint64))
    return doc, p1 - off[doc], x - p1, p2 - p1, gram[x], stretch


def _segments(data: np.ndarray, off: np.ndarray):
    """(documents, places' shifts, bytes, offsets) in pieces of bounded size; a long document is cut by its windows' starts."""
    for at, to in X.slices(off):
        if off[to] - off[at] <= SEGMENT:
            yield np.arange(at, to), np.zeros(to - at, np.int64), *X.fit(data, off, at, to)
            continue
        for s in range(int(off[at]), int(off[to]), SEGMENT // 2):
            e = min(int(off[to]), s + SEGMENT // 2 + LENGTH - 1)
            yield np.array([at]), np.array([s - off[at]]), data[s:e], np.array([0, e - s])


class _Tuples:
    """Anchor tuples of many texts, thinned to one per stretch and split by shard."""

    def __init__(self, shards: int) -> None:
        self.shards, self.held, self.n = shards, [], 0

    def add(self, doc_ids, p1, xo, span, ah, ch, kind=_ASK) -> None:
        self.held.append((ah, ch, doc_ids, p1.astype(np.int32), xo.astype(np.uint8), span.astype(np.uint8), np.full(len(p1), kind, np.uint8)))
        self.n += len(p1)

    def flush(self):
        ah, ch, doc, p1, xo, span, kind = (np.concatenate(v) for v in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.lexsort((p1, doc, ch ^ (ah << np.uint64(1)), kind))
        a, b, k = ah[order], ch[order], kind[order]
        again = np.zeros(len(order), bool)
        again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (k[1:] == k[:-1])
        kind[order[again]] = _DONE
        shard = ((ah >> np.uint64(24)) % np.uint64(self.shards)).astype(np.int32)
        shard[kind == _DONE] = (doc[kind == _DONE] % self.shards).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            i = order[bounds[s] : bounds[s + 1]]
            rows.append((s, len(i), _six(ah[i]), _six(ch[i]), doc[i].tobytes(), p1[i].tobytes(), xo[i].tobytes(), span[i].tobytes(), kind[i].tobytes()))
        return _batch(rows, _TUPLE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


def _six(h: np.ndarray) -> bytes:
    """The upper 48 bits; with both hashes, 96 bits tell stretches apart."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _eight(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _find(batches, shards: int, hot: np.ndarray):
    held = _Tuples(shards)
    for b in batches:
        data, off = X.column(b, "text")
        ids = np.asarray(b.column(0)).astype(np.int64)
        for docs, shift, part, po in _segments(data, off):
            doc, p1, xo, span, ah, ch = anchors(part, po)
            crowd = hot[np.minimum(np.searchsorted(hot, ah), len(hot) - 1)] == ah if len(hot) else np.zeros(len(ah), bool)
            if crowd.any():
                d, s = np.repeat(doc[crowd], span[crowd] + 1), X.ragged(p1[crowd], span[crowd] + 1)
                for at in range(0, len(d), FLUSH):  # hashes of one part of the windows at a time
                    dd, ss = d[at : at + FLUSH], s[at : at + FLUSH]
                    zero = np.zeros(len(dd), np.uint8)
                    held.add(ids[docs[dd]], ss + shift[dd], zero, zero, *_window_hashes(part, ss + po[dd]), _WINDOW)
                    if held.n >= FLUSH:
                        yield held.flush()
                doc, p1, xo, span, ah, ch = (v[~crowd] for v in (doc, p1, xo, span, ah, ch))
            held.add(ids[docs[doc]], p1 + shift[doc], xo, span, ah, ch)
            if held.n >= FLUSH:
                yield held.flush()
    if held.n:
        yield held.flush()


def _window_hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at these places: of the whole, and of its first half mixed with the whole."""
    c = X.prefix_hash(data)
    whole = X.range_hash(c, start, start + LENGTH)
    return whole, X.mix(X.range_hash(c, start, start + LENGTH // 2) + whole * np.uint64(0x9E3779B97F4A7C15))


def _heavy(batches):
    for b in batches:
        data, off = X.column(b, "text")
        for _, _, part, po in _segments(data, off):
            _, _, _, _, ah, ch = anchors(part, po)
            distinct = np.unique(np.stack([ah, ch], 1), axis=0)[:, 0] if len(ah) else ah
            values, counts = np.unique(distinct, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["ah", "n"])


def hot_anchors(docs: DataFrame, hot: int, sample: int) -> np.ndarray:
    """Sorted hashes of the anchors with likely more than ``hot`` stretches; at most the number of all anchors over ``hot``."""
    some = docs if sample == 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    heavy = some.mapInArrow(X.lean(_heavy), "ah long, n long").groupBy("ah").agg(F.sum("n").alias("n"))
    rows = heavy.where(F.col("n") > hot / sample).select("ah").toArrow()
    return np.sort(rows["ah"].to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _per_doc(doc: np.ndarray, rec: np.ndarray) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, rec = doc[order], rec[order]
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(doc))[: len(begin)]
    return pa.table({"doc_id": pa.array(doc[begin].astype(np.int64)), "rec": pa.array([rec[s:e].tobytes() for s, e in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary())})


def _settle(table: pa.Table) -> pa.Table:
    """A shard's tuples: repeats of whole stretches and of hot anchors' windows, and the stretches whose bytes are needed."""
    ah, ch = (_eight(b"".join(table.column(c).to_pylist())) for c in ("ah", "ch"))
    doc, p1 = _joined(table, "doc", np.int64), _joined(table, "p1", np.int32)
    xo, span, kind = (_joined(table, c, np.uint8) for c in ("xo", "span", "kind"))
    done = np.flatnonzero(kind == _DONE)
    live = np.flatnonzero(kind != _DONE)
    order = live[np.lexsort((kind[live], ah[live]))]
    a, k = ah[order], kind[order]
    same = (a[1:] == a[:-1]) & (k[1:] == k[:-1])
    order = order[np.append(False, same) | np.append(same, False)] if len(order) else order
    order = order[np.lexsort((p1[order], doc[order], ch[order], ah[order], kind[order]))]
    a, b, k = ah[order], ch[order], kind[order]
    new_a = np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1]))[: len(order)]
    new = new_a | np.append(True, b[1:] != b[:-1])[: len(order)]
    group = np.cumsum(new_a) - 1
    stretches = np.bincount(group, weights=new) if len(order) else np.zeros(0)
    ask = new & (stretches[group] > 1) & (k == _ASK) if len(order) else new
    pick = np.concatenate([done, order[~new], order[ask]])
    rec = np.zeros(len(pick), _REC)
    rec["p1"], rec["span"], rec["xo"], rec["ah"] = p1[pick], span[pick], xo[pick], ah[pick]
    if ask.any():
        rec["kind"][len(pick) - int(ask.sum()) :] = _ASK
    return _per_doc(doc[pick], rec)


def _records(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), _REC) if values is not None else np.zeros(0, _REC)


_CONTEXT = "shard int, doc binary, p1 binary, xo binary, span binary, ah binary, bytes binary"


def _contexts(batches, shards: int):
    """The asked stretches' bytes, each in a row of LEFT + LENGTH bytes with the anchor at LEFT."""
    width = LEFT + LENGTH
    held: dict[int, list] = {}
    size = 0

    def flush():
        return _batch([(s, *(b"".join(v) for v in zip(*parts, strict=True))) for s, parts in held.items()], _CONTEXT)

    for b in batches:
        data, off = X.column(b, "text")
        ids, recs = b.column(0).to_pylist(), b.column(2).to_pylist()
        for d, values in enumerate(recs):
            rec = _records(values)
            text = data[off[d] : off[d + 1]]
            asked = rec[rec["kind"] == _ASK]
            for at in range(0, len(asked), 1 << 16):
                r = asked[at : at + (1 << 16)]
                p1, xo, span = r["p1"].astype(np.int64), r["xo"].astype(np.int64), r["span"].astype(np.int64)
                place = p1[:, None] + xo[:, None] - LEFT + np.arange(width)
                ok = (place >= p1[:, None]) & (place < (p1 + span + LENGTH)[:, None])
                body = np.where(ok, text[np.clip(place, 0, len(text) - 1)], 0).astype(np.uint8)
                shard = (r["ah"] >> np.uint64(24)) % np.uint64(shards)
                cols = (p1.astype(np.int32), r["xo"], r["span"], r["ah"], body)
                for s in np.unique(shard).tolist():
                    i = np.flatnonzero(shard == s)
                    held.setdefault(int(s), []).append((np.full(len(i), ids[d], np.int64).tobytes(), *(np.ascontiguousarray(v[i]).tobytes() for v in cols)))
                    size += len(i) * (width + 24)
                if size > 32 << 20:
                    yield flush()
                    held.clear()
                    size = 0
    if held:
        yield flush()


def _induce(table: pa.Table) -> pa.Table:
    """Repeats among the windows of a shard's stretches."""
    doc, p1 = _joined(table, "doc", np.int64), _joined(table, "p1", np.int32).astype(np.int64)
    xo, span = (_joined(table, c, np.uint8).astype(np.int64) for c in ("xo", "span"))
    ah = _joined(table, "ah", np.uint64)
    body = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, LEFT + LENGTH)
    row, offset = induced_repeats(ah, body, doc, p1, xo, span)
    d, p = doc[row], p1[row] + xo[row] - offset
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (np.arange(1, len(p)) % 200 == 0))) if len(p) else p
    rec = np.zeros(len(begin), _REC)
    rec["p1"] = p[begin]
    rec["span"] = np.append(begin[1:], len(p)) - begin - 1
    return _per_doc(d[begin], rec)


def induced_repeats(ah: np.ndarray, body: np.ndarray, doc: np.ndarray, p1: np.ndarray, xo: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of every window that an equal one of the same anchor precedes.

    Suffix tuples stand in sorted order with the common prefix of neighbours;
    each round prepends one byte.
    """
    n = len(ah)
    _, group = np.unique(ah, return_inverse=True)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((p1 + xo, doc))] = np.arange(n)
    right = np.ascontiguousarray(body[:, LEFT:])
    order = np.lexsort((np.argsort(np.argsort(right.view(f"S{LENGTH}").ravel(), kind="stable"), kind="stable"), group))
    near = np.minimum(right[order[1:]] == right[order[:-1]], True)
    prefix = np.zeros(n, np.int64)
    prefix[1:] = np.where(near.all(1), LENGTH, near.argmin(1))
    prefix[1:][group[order[1:]] != group[order[:-1]]] = 0
    rows, offsets = [], []
    for o in range(LEFT + 1):
        if o:
            stay = np.flatnonzero(xo[order] >= o)
            if len(stay) < 2:
                break
            kept = order[stay]
            byte = body[kept, LEFT - o]
            pick = np.lexsort((byte, group[kept]))
            place = stay[pick]  # places in the order before
            fresh, byte = kept[pick], byte[pick]
            same = (byte[1:] == byte[:-1]) & (group[fresh][1:] == group[fresh][:-1])
            between = np.zeros(len(fresh), np.int64)
            i = np.flatnonzero(same)
            if len(i):
                ends = np.stack([place[i] + 1, place[i + 1] + 1], 1).ravel()
                between[i + 1] = 1 + np.minimum.reduceat(np.append(prefix, 0), ends)[::2]
            order, prefix = fresh, np.minimum(between, LENGTH)
        inside = xo[order] - span[order] <= o
        cls = np.cumsum(prefix < LENGTH)[inside]
        row = order[inside]
        if len(row) > 1:
            begin = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
            first = np.minimum.reduceat(rank[row], begin)
            later = rank[row] > np.repeat(first, np.diff(np.append(begin, len(row))))
            rows.append(row[later])
            offsets.append(np.full(int(later.sum()), o))
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (np.zeros(0, np.int64),) * 2


def repeat_records(docs: DataFrame, scratch: X.Scratch, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, rec) with the repeated windows of each document that has any; docs: doc_id (a long of its own for each row, in the documents' order), text."""
    spark = docs.sparkSession
    X.small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(X.parallelism(spark), -(-int(total) // SHARD_TEXT))
    crowded = hot_anchors(docs, max(hot, shards) if hot >= HOT else hot, sample)

    tuples = docs.mapInArrow(X.lean(lambda it: _find(it, shards, crowded)), _TUPLE)
    first = tuples.repartition(shards, "shard").groupBy("shard").applyInArrow(_settle, "doc_id long, rec binary")
    first = scratch.kept(first.groupBy("doc_id").agg(F.collect_list("rec").alias("rec")))
    asked = docs.join(first, "doc_id").select("doc_id", "text", "rec").mapInArrow(X.lean(lambda it: _contexts(it, shards)), _CONTEXT)
    second = asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_induce, "doc_id long, rec binary")
    return first.withColumn("rec", F.explode("rec")).union(second).groupBy("doc_id").agg(F.collect_list("rec").alias("rec"))


def removed_mask(rec: np.ndarray, n: int) -> np.ndarray:
    rec = rec[rec["kind"] == _DONE]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, rec["p1"], 1)
    np.add.at(edge, rec["p1"] + rec["span"].astype(np.int64) + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 100-byte string that covers it also starts earlier, in a
    document of smaller doc_id or earlier in the same one. Matches never cross
    documents and are judged on the input. Null counts as empty; texts under
    100 bytes lose nothing; rows that repeat a doc_id are one document (the
    smallest text) and rows without one are left out. Other columns are
    ignored; an empty table gives no rows. doc_id is a whole number.
    """
    docs = X.one_row_per_key(docs, "doc_id", "text")
    scratch = X.Scratch(docs.sparkSession)

    def finish(batches):
        for b in batches:
            data, off = X.column(b, "text")
            rows = []
            for d, rec in enumerate(b.column(2).to_pylist()):
                text = data[off[d] : off[d + 1]]
                if rec is None:
                    rows.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
                    continue
                gone = removed_mask(_records(rec), len(text))
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if len(gone) else 0
                rows.append((len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    records = scratch.saved(repeat_records(docs, scratch, hot, sample))
    scratch.done(last=1)
    joined = docs.join(records, "doc_id", "left").select("doc_id", "text", "rec")
    return joined.mapInArrow(X.lean(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _numbered(docs: DataFrame, scratch: X.Scratch) -> tuple[DataFrame, int]:
    """(row, id, text) with an id of its own for each row that has a doc_id, rising with (doc_id, text); and how many folders that needs to stay."""
    rows = X.wrapped(docs, F.col("doc_id").alias("id"), "text")
    whole = isinstance(docs.schema["doc_id"].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    if whole and docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty():
        return rows.withColumn("id", F.col("id").cast("long")), 0
    rows = rows.withColumn("tie", F.xxhash64("row"))
    rows = rows.repartitionByRange(X.parallelism(docs.sparkSession), "id", "text", "tie").sortWithinPartitions("id", "text", "tie")
    return scratch.saved(rows.select("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id()).alias("id"), "text")), 1


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out of their texts and n_chars counted anew, other columns as they are.

    Characters of which only a part would go stay whole. A text that is all
    repeats becomes empty; its row stays. Rows that repeat a doc_id are
    documents of their own, in the order of their texts, so the second of two
    equal rows loses what it repeats; rows without a doc_id stay as they are
    and are not held against others. Null texts stay null; an empty table
    gives no rows; doc_id may be of any type that sorts.
    """
    scratch = X.Scratch(docs.sparkSession)
    rows, folders = _numbered(docs, scratch)
    records = scratch.saved(repeat_records(rows.where("id is not null").select(F.col("id").alias("doc_id"), "text"), scratch))
    scratch.done(last=1 + folders)
    joined = rows.join(records.withColumnRenamed("doc_id", "id"), "id", "left").select("row", "text", "rec")

    def strip(batches):
        for b in batches:
            data, off = X.column(b, "text")
            texts = b.column(1).to_pylist()
            for d, rec in enumerate(b.column(2).to_pylist()):
                if rec is None or texts[d] is None:
                    continue
                text = data[off[d] : off[d + 1]]
                kept = ~removed_mask(_records(rec), len(text))
                lead = np.flatnonzero((text & 0xC0) != 0x80)
                kept = np.repeat(np.logical_or.reduceat(kept, lead), np.diff(np.append(lead, len(text))))
                texts[d] = text[kept].tobytes().decode()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "cut"])

    schema = T.StructType().add("row", docs.schema).add("cut", "string")
    out = joined.mapInArrow(X.lean(strip), schema)
    fresh = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
