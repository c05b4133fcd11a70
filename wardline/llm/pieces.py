"""SentencePiece encoding and decoding by suffix-array matching.

A BPE model never joins pieces over the start of a run of blanks, so a text
falls into units (blanks and the signs up to the next blank) that are encoded
alone. A task indexes the text of the units it has not met before in a suffix
array and finds every vocabulary piece in it by binary search; the ranges are
all the places where a piece stands, i.e. the edges of the segmentation
lattice. Sorted by position, the edges are relaxed: each round joins, in every
unit, the neighbouring pieces whose joint edge has the best score, the leftmost
at a tie, until no edge is left to take. Characters without a piece fall back
to bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from wardline.llm import textops as X

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MOST_UNITS = 1_000_000
LONG_UNIT = 64
_LEN_BITS = 6


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray | None
    unknown: int
    normal: np.ndarray
    control: np.ndarray

    @classmethod
    def load(cls, model_file: str = MODEL_FILE) -> Vocabulary:
        """Read a BPE model whose normalisation is the identity, with a dummy prefix and blanks kept."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        if sp.encode(f"  a{BLANK}ﬁ ") and sp.decode(sp.encode("  ﬁ a ")) != "  ﬁ a ":
            raise ValueError("only models that keep their text as it is are supported")
        normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
        control = np.array([sp.is_control(i) for i in range(n)])
        bytes_ = np.array([i for i in range(n) if sp.is_byte(i)])
        return cls([sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), bytes_ if len(bytes_) == 256 else None, sp.unk_id(), normal, control)

    @cached_property
    def _alphabet(self) -> np.ndarray:
        return np.unique(np.array([ord(c) for i in np.flatnonzero(self.normal) for c in self.pieces[i]], np.uint32))

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Code points as places in the alphabet of the pieces from 1; 0 for others."""
        at = np.minimum(np.searchsorted(self._alphabet, points), len(self._alphabet) - 1)
        return np.where(self._alphabet[at] == points, at + 1, 0).astype(">u2")

    @cached_property
    def _searchable(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, least key, greatest key) of all normal pieces."""
        ids = np.flatnonzero(self.normal)
        lengths = np.array([len(self.pieces[i]) for i in ids])
        low = np.zeros((len(ids), self.longest), ">u2")
        high = np.full((len(ids), self.longest), 0xFFFF, ">u2")
        for k, i in enumerate(ids):
            s = self.symbols(np.array([ord(c) for c in self.pieces[i]], np.uint32))
            low[k, : len(s)] = high[k, : len(s)] = s
        kind = f"S{2 * self.longest}"
        return ids, lengths, low.view(kind).ravel(), high.view(kind).ravel()

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, ok in zip(self.pieces, self.normal, strict=True) if ok), default=1)

    def edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of all pieces: sorted (position << _LEN_BITS | length), and the piece of each."""
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(self.longest, ">u2")]).astype(">u2")
        at = np.flatnonzero(symbols)
        keys = np.ascontiguousarray(sliding_window_view(padded, self.longest)[at]).view(f"S{2 * self.longest}").ravel()
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        ids, lengths, low, high = self._searchable
        first, last = np.searchsorted(array, low, "left"), np.searchsorted(array, high, "right")
        size = np.maximum(0, last - first)
        where = at[order[X.ragged(first, size)]] if n else np.zeros(0, np.int64)
        key = (where << _LEN_BITS) | np.repeat(lengths, size)
        by = np.argsort(key)
        return key[by], np.repeat(ids, size)[by]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, bounds of each unit); a unit's blanks are plain blanks."""
        text = "".join(u.decode("utf-8") + "\0" for u in units)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.array([len(u.decode("utf-8")) + 1 for u in units])
        ends = np.cumsum(size)
        stop = np.zeros(len(points), bool)
        stop[ends - 1] = True
        points = np.where(points == 32, ord(BLANK), points)
        symbols = self.symbols(points)
        symbols[stop] = 0
        keys, ids = self.edges(symbols)
        length = self._relax(keys, ids, stop, ends - size, size - 1)
        taken = np.flatnonzero(length)
        piece = _find(keys, ids, (taken << _LEN_BITS) | np.minimum(length[taken], (1 << _LEN_BITS) - 1))
        unit = np.searchsorted(ends, taken, "right")
        if self.byte_ids is None or not (piece < 0).any():
            out, of = np.where(piece < 0, self.unknown, piece), unit
        else:
            raw = [[int(p)] if p >= 0 else self.byte_ids[list(chr(points[t]).encode())].tolist() for p, t in zip(piece.tolist(), taken.tolist(), strict=True)]
            out, of = np.array([i for r in raw for i in r]), np.repeat(unit, [len(r) for r in raw])
        return out.astype(np.int32), np.searchsorted(of, np.arange(len(units) + 1))

    def _relax(self, keys: np.ndarray, ids: np.ndarray, stop: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length of the piece that starts at each position, 0 where none does."""
        length = (~stop).astype(np.int64)
        long = np.flatnonzero(size > LONG_UNIT)
        for u in long.tolist():
            self._relax_long(keys, ids, int(begin[u]), int(begin[u] + size[u]), length)
        alive = ~stop
        for u in long.tolist():
            alive[begin[u] : begin[u] + size[u]] = False
        pos = np.flatnonzero(alive)
        unit = np.searchsorted(begin, pos, "right") - 1
        # per symbol: start, unit, the score of joining it with the next one
        joined = self._joint(keys, ids, pos, unit, length)
        while True:
            can = np.flatnonzero(joined > -np.inf)
            if not len(can):
                return length
            u = unit[can]
            first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            best = np.maximum.reduceat(joined[can], first)
            is_best = joined[can] == np.repeat(best, np.diff(np.append(first, len(can))))
            pick = can[is_best]
            pick = pick[np.append(True, unit[pick][1:] != unit[pick][:-1])]
            length[pos[pick]] += length[pos[pick + 1]]
            length[pos[pick + 1]] = 0
            keep = np.ones(len(pos), bool)
            keep[pick + 1] = False
            busy = np.zeros(len(begin), bool)
            busy[unit[pick]] = True
            keep &= busy[unit]
            changed = np.zeros(len(pos), bool)
            changed[pick] = True
            changed[pick[pick > 0] - 1] = True
            pos, unit, joined, changed = pos[keep], unit[keep], joined[keep], changed[keep]
            at = np.flatnonzero(changed)
            joined[at] = self._joint(keys, ids, pos, unit, length, at)

    def _joint(self, keys, ids, pos, unit, length, at=None) -> np.ndarray:
        """Score of the edge that joins each symbol with its successor in the unit; -inf without one."""
        at = np.arange(len(pos)) if at is None else at
        after = np.minimum(at + 1, max(0, len(pos) - 1))
        ok = (at + 1 < len(pos)) & (unit[after] == unit[at])
        total = length[pos[at]] + length[pos[after]]
        ok &= total <= self.longest
        out = np.full(len(at), -np.inf)
        i = np.flatnonzero(ok)
        piece = _find(keys, ids, (pos[at[i]] << _LEN_BITS) | total[i])
        out[i[piece >= 0]] = self.scores[piece[piece >= 0]]
        return out

    def _relax_long(self, keys, ids, begin: int, end: int, length: np.ndarray) -> None:
        """The same for one long unit, with a heap of joinable neighbours."""
        lo, hi = np.searchsorted(keys, [begin << _LEN_BITS, end << _LEN_BITS])
        edge = dict(zip(keys[lo:hi].tolist(), self.scores[ids[lo:hi]].tolist(), strict=True))
        after = {p: p + 1 for p in range(begin, end)}
        before = {p + 1: p for p in range(begin, end)}
        span = dict.fromkeys(range(begin, end), 1)

        def push(p: int) -> None:
            q = after[p]
            if q < end and (s := edge.get((p << _LEN_BITS) | (span[p] + span[q]))) is not None and span[p] + span[q] <= self.longest:
                heapq.heappush(heap, (-s, p, span[p], span[q]))

        heap: list[tuple[float, int, int, int]] = []
        for p in range(begin, end):
            push(p)
        while heap:
            _, p, a, b = heapq.heappop(heap)
            q = p + a
            if span.get(p) != a or span.get(q) != b or after[p] != q:
                continue
            span[p] = a + b
            del span[q]
            after[p] = after[q]
            before[after[q]] = p
            push(p)
            if p > begin:
                push(before[p])
        length[begin:end] = 0
        for p, n in span.items():
            length[p] = n

    @cached_property
    def _spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of every id's text end to end, and their bounds."""
        text = [b"" if c else p.replace(BLANK, " ").encode() for p, c in zip(self.pieces, self.control, strict=True)]
        if self.byte_ids is not None:
            for b, i in enumerate(self.byte_ids.tolist()):
                text[i] = bytes([b])
        text[self.unknown] = " ⁇ ".encode()
        return np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in text])])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Texts of runs of ids, without the blank that encoding puts before each."""
        data, off = self._spelling
        size = (off[1:] - off[:-1])[ids]
        out = data[X.ragged(off[ids], size)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(size)])[first]
        return [out[s + 1 : e] if out[s : s + 1] == b" " and s < e else out[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


@dataclass
class Encoder:
    """Encodes texts; remembers the units met so far, up to MOST_UNITS."""

    vocabulary: Vocabulary
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds of each text)."""
        raw = data.tobytes()
        mark = BLANK.encode()
        if mark in raw:
            texts = [raw[s:e].replace(mark, b" ") for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        size = np.diff(off)
        lead = size > 0
        start = off + np.concatenate([[0], np.cumsum(lead)])
        buf = np.full(len(data) + int(lead.sum()), 32, np.uint8)
        buf[X.ragged(start[:-1][lead] + 1, size[lead])] = data
        blank = buf == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[start[:-1][lead]] = True
        at = np.flatnonzero(begins)
        end = np.append(at[1:], len(buf)) if len(at) else at
        h, where, which = np.unique(X.range_hash(X.prefix_hash(buf), at, end), return_index=True, return_inverse=True)
        slot = self._slots(h, buf, at[where], end[where])[which]
        n = (self.first[1:] - self.first[:-1])[slot]
        ids = self.ids[X.ragged(self.first[slot], n)]
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, start)]

    def _slots(self, h: np.ndarray, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.known) > MOST_UNITS:
            self.known, self.slot, self.ids, self.first = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64))
        slot = _find(self.known, self.slot, h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = buf.tobytes()
            ids, first = self.vocabulary.encode_units([raw[s:e] for s, e in zip(at[new].tolist(), end[new].tolist(), strict=True)])
            slot[new] = len(self.first) - 1 + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.ids) + first[1:]])
            self.ids = np.concatenate([self.ids, ids])
            known = np.concatenate([self.known, h[new]])
            order = np.argsort(known)
            self.known, self.slot = known[order], np.concatenate([self.slot, slot[new]])[order]
        return slot


def _with_vocabulary(docs: DataFrame, model_file: str):
    spark = docs.sparkSession
    X.small_batches(spark)
    return spark.sparkContext.broadcast(Vocabulary.load(model_file))


def encode(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, n_tokens and ids of every document row's whole text.

    Null and empty texts have no tokens; repeated rows are encoded alike; other
    columns are ignored. The vocabulary, whose size is the model's, is
    broadcast.
    """
    shared = _with_vocabulary(docs, model_file)

    def task(batches):
        encoder = Encoder(shared.value)
        for b in batches:
            data, off = X.column(b, "text")
            for at, to in X.slices(off):
                ids, first = encoder.encode(*X.fit(data, off, at, to))
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(X.lean(task), f"doc_id {kind}, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give the empty text, broken bytes the replacement character."""
    shared = _with_vocabulary(tokens, model_file)

    def task(batches):
        for b in batches:
            runs = [np.asarray(r if r is not None else [], np.int64) for r in b.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
            texts = shared.value.decode(np.concatenate([np.zeros(0, np.int64), *runs]), first)
            yield pa.RecordBatch.from_arrays([b.column(0), X.strings(texts)], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(X.lean(task), f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """One row per document row: doc_id, n_tokens, n_byte_tokens, ids_sha256, decoded_chars, decoded_sha256, exact.

    ids_sha256 is of the ids, comma-joined; decoded_* are of the text decoded
    from them; exact says that it equals the text (null: empty). Repeated rows are
    encoded alike, each in a row of its own; an empty table gives no rows; other
    columns are ignored.
    """
    shared = _with_vocabulary(docs, model_file)

    def task(batches):
        v = shared.value
        encoder = Encoder(v)
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.byte_ids if v.byte_ids is not None else []] = True
        for b in batches:
            data, off = X.column(b, "text")
            for at, to in X.slices(off):
                part, po = X.fit(data, off, at, to)
                ids, first = encoder.encode(part, po)
                back, raw = v.decode(ids, first), part.tobytes()
                of_bytes = np.concatenate([[0], np.cumsum(is_byte[ids])])[first]
                spelled = [hashlib.sha256(",".join(map(str, ids[s:e].tolist())).encode()).hexdigest() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                cols = [b.column(0)[at:to], np.diff(first), np.diff(of_bytes), spelled, [len(t.decode("utf-8", "replace")) for t in back], [hashlib.sha256(t).hexdigest() for t in back], [t == raw[s:e] for t, s, e in zip(back, po[:-1].tolist(), po[1:].tolist(), strict=True)]]
                kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_chars", "decoded_sha256", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(X.lean(task), f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_chars long, decoded_sha256 string, exact boolean")
