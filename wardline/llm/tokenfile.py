"""Token ids in files of directly addressable codes.

A file holds the ids of consecutive documents as levels of chunks: level 0 has the low bits of every id, level 1 the
next bits of those ids that need more, and so on. A bitmap a level says which codes go on, and a directory of running
counts, one for each block of 512 bits, turns a position in one level into a position in the next with one look-up and
the count of the bits of one block. So the token at any place is read with a few reads of a few bytes, without decoding a
block. The widths of the levels are chosen for each file from the sizes of its ids.

Writing: documents are range-partitioned by id, a task encodes its range in order and closes a file at a given number of
ids. A file counts once the row that names it stands in the manifest, which Spark commits: what a lost or repeated
attempt has written is named by nobody. Places before a file are sums over the manifest.

Encoding: nothing in this tokenizer reaches over white space, nor over the bounds between a Latin letter or digit and an
ASCII sign other than ``'<|>``. A task cuts its texts there, finds the different pieces of a slice and gives only those to the library.
"""

from __future__ import annotations

import array
import bisect
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm import textops as X

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
FILE_IDS = 1 << 23
READ_IDS = 1 << 20
MOST_PIECES = 600_000
MAGIC = b"WARDTOK1"
BLOCK_BITS = 512
SLICE_BYTES = 4 << 20

_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter or digit, 2 a sign that never stands in one word with a letter, 3 anything else
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[list(b"'<|>")] = 3  # contractions, and the signs of special tokens


# the file format


def widths(ids: np.ndarray) -> list[int]:
    """Bits of each level, from the lowest, so that codes, bitmaps and directories take the least room."""
    sizes = np.zeros(33, np.int64)
    bits = np.zeros(len(ids), np.int64)
    for b in range(32):
        bits += (ids >> np.uint32(b)) > 0
    np.add.at(sizes, np.maximum(bits, 1), 1)
    most = int(np.flatnonzero(sizes).max(initial=1))
    needs = len(ids) - np.cumsum(sizes)  # ids of more than s bits
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (most + 1)
    for s in range(most - 1, -1, -1):
        best[s] = min((float(needs[s]) * (e - s + (1 + 32 / BLOCK_BITS if e < most else 0)) + best[e][0], [e - s, *best[e][1]]) for e in range(s + 1, most + 1))
    return best[0][1]


def pack(codes: np.ndarray, width: int) -> bytes:
    """Codes of some bits each, end to end, the low bits first. Eight codes fill ``width`` bytes, so each of the eight has fixed places in them."""
    rows = -(-len(codes) // 8)
    padded = np.zeros(8 * rows, np.uint64)
    padded[: len(codes)] = codes
    eight = padded.reshape(rows, 8)
    out = np.zeros((rows, width), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        moved = eight[:, j] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, byte + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(raw: np.ndarray, width: int) -> np.ndarray:
    """The codes of whole groups of eight."""
    groups = raw.reshape(-1, width)
    out = np.zeros((len(groups), 8), np.uint32)
    kind = np.uint32 if width <= 25 else np.uint64
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        word = groups[:, byte].astype(kind)
        for k in range(1, -(-(shift + width) // 8)):
            word |= groups[:, byte + k].astype(kind) << kind(8 * k)
        out[:, j] = (word >> kind(shift)) & kind((1 << width) - 1)
    return out.ravel()


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A file of ids; starts has one entry more than doc_ids, the places in this file where documents begin and end."""
    parts, levels, at = [], [], 0
    sections: list[bytes] = [doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    left = ids.astype(np.uint32)
    chosen = widths(left)
    for k, width in enumerate(chosen):
        level = {"width": width, "n": len(left)}
        sections.append(pack(left & np.uint32((1 << width) - 1), width))
        level["codes"] = len(sections) - 1
        if k + 1 < len(chosen):
            more = left >> np.uint32(width)
            on = more > 0
            bitmap = np.packbits(on, bitorder="little")
            bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK_BITS // 8), np.uint8)])
            ones = np.bitwise_count(bitmap).reshape(-1, BLOCK_BITS // 8).sum(1, dtype=np.int64)
            sections += [bitmap.tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()]
            level["bits"] = len(sections) - 2
            level["ranks"] = len(sections) - 1
            left = more[on]
        levels.append(level)
    for s in sections:
        parts.append([at, len(s)])
        at += len(s)
    head = json.dumps({"n_ids": len(ids), "n_docs": len(doc_ids), "levels": levels, "sections": parts}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class TokenFile:
    """A file opened for reading by place; nothing but what is asked for is read."""

    def __init__(self, path: str) -> None:
        fs, at = _filesystem(path)
        self._file = fs.open_input_file(at)
        if self._file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        size = int.from_bytes(self._file.read_at(4, 8), "little")
        head = json.loads(self._file.read_at(size, 12))
        self.n_ids, self.n_docs, self._levels, self._sections = head["n_ids"], head["n_docs"], head["levels"], head["sections"]
        self._base = 12 + size

    def close(self) -> None:
        self._file.close()

    def _read(self, section: int, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self._file.read_at(n, self._base + self._sections[section][0] + at), np.uint8)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, starts), the starts with the end of the last document."""
        return self._read(0, 0, 8 * self.n_docs).view("<i8"), self._read(1, 0, 8 * (self.n_docs + 1)).view("<u8").astype(np.int64)

    def _rank(self, level: dict, at: int) -> int:
        """Codes before a place that go on."""
        block = at // BLOCK_BITS
        before = int(self._read(level["ranks"], 4 * block, 4).view("<u4")[0])
        inside = at - block * BLOCK_BITS
        if not inside:
            return before
        bits = self._read(level["bits"], block * (BLOCK_BITS // 8), -(-inside // 8)).copy()
        if inside % 8:
            bits[-1] &= (1 << (inside % 8)) - 1
        return before + int(np.bitwise_count(bits).sum())

    def tokens(self, first: int, end: int) -> np.ndarray:
        """The ids of places first to end (not included): in each level, those that go on are neighbours again."""
        if not 0 <= first <= end <= self.n_ids:
            raise IndexError((first, end))
        out = np.zeros(end - first, np.uint32)
        live, shift = np.arange(end - first), 0
        for level in self._levels:
            n, width = end - first, level["width"]
            if not n:
                break
            group = first // 8
            codes = unpack(self._read(level["codes"], group * width, (-(-end // 8) - group) * width), width)[first - 8 * group : end - 8 * group]
            if shift:
                out[live] |= codes << np.uint32(shift)
            else:
                out[:] = codes
            shift += width
            if "bits" in level:
                bits = self._read(level["bits"], first // 8, -(-end // 8) - first // 8)
                live = live[np.unpackbits(bits, bitorder="little")[first % 8 : first % 8 + n].astype(bool)]
                first = self._rank(level, first)
                end = first + len(live)
        return out

    def token(self, at: int) -> int:
        return int(self.tokens(at, at + 1)[0])


# encoding


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of each text, and each text's first one (an entry more than texts)."""
    kind = _KIND[data]
    n = len(data)
    # U+00C0 to U+023F are letters of two bytes, but the signs of multiplication and division; the lower case of U+0130 ends in a mark
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    code = data[lead].astype(np.int64) << 8 | data[lead + 1]
    lead = lead[~np.isin(code, (0xC397, 0xC3B7, 0xC4B0))]
    kind[lead] = kind[lead + 1] = 1
    bound = np.ones(n + 1, bool)
    a, b = kind[:-1], kind[1:]
    if n:
        bound[1:n] = (a == 0) | (b == 0) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    bound[off] = True
    cuts = np.flatnonzero(bound)
    starts, ends = cuts[:-1], cuts[1:]
    ink = kind[starts] != 0 if n else np.zeros(0, bool)
    starts, ends = starts[ink], ends[ink]
    return starts, ends, np.searchsorted(starts, off)


class Encoder:
    """A tokenizer that meets each piece once: what it has met it keeps, up to a number of pieces.

    A piece of letters is one word to the tokenizer. Those of ASCII letters go straight to the library's merges in lower case;
    others are joined by blanks, encoded together and cut where a word ends, if that gives as many words as there were pieces.
    """

    def __init__(self, path: str, most: int = MOST_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        suffix = self._model.end_of_word_suffix
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._ends[[i for w, i in self._tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self._joins = bool(suffix)
        self._most = most
        self._forget()

    def _forget(self) -> None:
        self._met: dict[str, int] = {}
        self._flat, self._bounds = array.array("I"), array.array("q", [0])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds of each text)."""
        if b"<|" not in data.tobytes():  # what looks like a special token keeps its case
            data = np.where((data >= 65) & (data <= 90) & (np.append(data[1:], 0) < 128), data + 32, data).astype(np.uint8)
        starts, ends, first = pieces(data, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[_KIND[data] != 0])).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._met) + len(words) > self._most:
            self._forget()
        self._learn([w for w in words if w not in self._met])
        known = pa.LargeListArray.from_arrays(np.array(self._bounds), np.array(self._flat, np.uint32))
        place = np.fromiter(map(self._met.__getitem__, words), np.int32, len(words))
        spelled = known.take(pa.array(place)).take(coded.indices)
        return np.asarray(spelled.flatten()), np.asarray(spelled.offsets)[first].astype(np.int64)

    def _keep(self, word: str, ids) -> None:
        self._met[word] = len(self._met)
        self._flat.extend(ids)
        self._bounds.append(len(self._flat))

    def _learn(self, words: list[str]) -> None:
        tokenize, keep, letters, rest = self._model.tokenize, self._keep, [], []
        for w in words:
            if self._joins and w.isalpha():
                if w.isascii():
                    keep(w, [t.id for t in tokenize(w.lower())])
                else:
                    letters.append(w)
            else:
                rest.append(w)
        runs = [letters[s : s + 64] for s in range(0, len(letters), 64)]
        for run, e in zip(runs, self._tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(run):
                rest += run
                continue
            flat = ids.tolist()
            for w, s, t in zip(run, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                keep(w, flat[s:t])
        for s in range(0, len(rest), 4096):
            some = rest[s : s + 4096]
            for w, e in zip(some, self._tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                keep(w, e.ids)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One a worker: tasks that follow each other know what their predecessors have met."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """A path as it is; a name is looked for among the public tokenizers of the machine that asks."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


MANIFEST = "file string, shard int, seq int, first_doc long, last_doc long, n_docs long, n_tokens long"


def _write(shard: int, batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, file_ids: int) -> Iterator[pa.RecordBatch]:
    """Files of the documents of one range, in order; a row for each."""
    encoder, (fs, at) = _encoder(tokenizer_path(tokenizer)), _filesystem(folder)
    ids: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = seq = 0

    def close() -> pa.RecordBatch:
        nonlocal held, seq
        doc, size = np.concatenate(docs), np.concatenate(sizes)
        name = f"{shard:08d}-{seq:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(encode_file(np.concatenate(ids), doc, np.concatenate([[0], np.cumsum(size)])))
        row = [[f"{folder}/{name}"], [shard], [seq], [int(doc[0])], [int(doc[-1])], [len(doc)], [int(size.sum())]]
        ids.clear(), docs.clear(), sizes.clear()
        held, seq = 0, seq + 1
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["file", "shard", "seq", "first_doc", "last_doc", "n_docs", "n_tokens"])

    for b in batches:
        data, off = X.column(b, "text")
        doc = np.asarray(b.column(0), np.int64)
        for s, e in X.slices(off, SLICE_BYTES):
            found, first = encoder.encode(*X.fit(data, off, s, e))
            size = np.diff(first) + 1
            out = np.full(len(found) + e - s, END_ID, np.uint32)
            ends = np.cumsum(size) - 1
            inner = np.ones(len(out), bool)
            inner[ends] = False
            out[inner] = found
            bounds, at_doc = np.concatenate([[0], np.cumsum(size)]), 0
            while at_doc < len(size):
                to = min(len(size), int(np.searchsorted(bounds, bounds[at_doc] + file_ids - held)))
                ids.append(out[bounds[at_doc] : bounds[to]])
                docs.append(doc[s + at_doc : s + to])
                sizes.append(size[at_doc:to])
                held += int(bounds[to] - bounds[at_doc])
                at_doc = to
                if held >= file_ids:
                    yield close()
    if held:
        yield close()


def write_ids(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text, add the end id, write all ids in ascending order of doc_id; returns the manifest, also kept in ``folder``/manifest.

    The manifest has a row a file: file, shard, seq, first_doc, last_doc, n_docs, n_tokens, and start, the number of ids
    before it. A file ends with the document that reaches ``file_ids``; a document is never split. Null and empty texts have the end id
    only. doc_id is a whole number; rows without one take no part; rows that repeat one are one document, whose smallest text
    stands. Other columns are ignored. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    X.small_batches(spark)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    rows = X.one_row_per_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    ranged = rows.repartitionByRange(4 * X.parallelism(spark), "doc_id").sortWithinPartitions("doc_id")

    def task(batches):
        from pyspark import TaskContext

        return _write(TaskContext.get().partitionId(), batches, f"{folder}/data", tokenizer, file_ids)

    ranged.mapInArrow(X.lean(task), MANIFEST).write.parquet(f"{folder}/files")
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/files")
    base, before = [], 0
    for r in sorted(files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):  # a number a partition
        base.append((r["shard"], before))
        before += r["n"]
    order = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = files.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    placed = inside.join(F.broadcast(spark.createDataFrame(base, "shard int, base long")), "shard")
    placed.select("file", "shard", "seq", "first_doc", "last_doc", "n_docs", "n_tokens", (F.col("base") + F.col("inside")).alias("start")).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, start long").parquet(f"{folder}/manifest")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; a file is read a million ids at a time."""
    X.small_batches(spark)

    def task(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                doc, first = file.documents()
                at = 0
                while at < len(doc):
                    to = max(at + 1, int(np.searchsorted(first, first[at] + READ_IDS, "right")) - 1)
                    raw = file.tokens(int(first[at]), int(first[to])).astype("<u4").tobytes()
                    cut = (4 * (first[at : to + 1] - first[at])).tolist()
                    crc = [zlib.crc32(raw[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[at:to]), pa.array(start + first[at:to]), pa.array(np.diff(first[at : to + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to
                file.close()

    files = manifest(spark, folder).select("file", "start").repartition(4 * X.parallelism(spark))
    return files.mapInArrow(X.lean(task), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(positions: DataFrame, folder: str) -> DataFrame:
    """position and token of every row of ``positions`` (column position, from 0 over all documents); null if there is no such place.

    Rows go to their file by binary search in the places where files start (one number a file, held by each task), are
    dealt by file and part of it, and read a few bytes each. Repeated positions are answered each; other columns are ignored.
    """
    spark = positions.sparkSession
    X.small_batches(spark)
    files = manifest(spark, folder).orderBy("start").select("file", "start", "n_tokens").toArrow()
    names, starts = files["file"].to_pylist(), files["start"].to_pylist()
    end = starts[-1] + files["n_tokens"][-1].as_py() if starts else 0

    def find(batches):
        for b in batches:
            asked = b.column(0).to_pylist()
            of = [bisect.bisect_right(starts, p) - 1 if p is not None and 0 <= p < end else -1 for p in asked]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[i] if i >= 0 else None for i in of], pa.string()), pa.array([p - starts[i] if i >= 0 else None for p, i in zip(asked, of, strict=True)], pa.int64())], names=["position", "file", "at"])

    def read(batches):
        open_path = file = None
        for b in batches:
            out = []
            for path, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if path is not None and path != open_path:
                    open_path, file = path, TokenFile(path)
                out.append(None if path is None else file.token(at))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["position", "token"])

    found = positions.select(F.col("position").cast("long").alias("position")).mapInArrow(find, "position long, file string, at long")
    dealt = found.repartition(X.parallelism(spark), "file", F.col("at").bitwiseAND(7)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(read, "position long, token long")


def token_digests(docs: DataFrame, tokenizer: str = TOKENIZER, file_ids: int = FILE_IDS) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32, read back from the files just written into the shared folder; see ``write_ids``."""
    spark = docs.sparkSession
    folder = f"{X.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer, file_ids)
    return documents(spark, folder)
