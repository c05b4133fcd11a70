"""Benchmark decontamination by training suffix arrays.

Each task takes the texts it reads as shards. In a shard, the positions whose
next words all occur in the benchmark's vocabulary (no other suffix can match a
window) are sorted into a word-level suffix array, and every test suffix is
found in it by binary search: the range of equal entries gives all places of
the match. From there each matched place is extended along the sorted test
suffixes to its longest verbatim match. Matched words are compared byte by byte.
The benchmark is taken in blocks of a fixed size, so what is broadcast does not
grow with either side. With one block texts are never shuffled; with more, each
block is a job of its own whose few hits are written and joined at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import textops as X

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: bytes of text in a shard; tables of this length stay with a worker
SHARD_BYTES = 1 << 20


class TestSuffixes:
    """A benchmark block's windows by length (sorted distinct keys over word numbers, with the items of each) and the suffix array of its long items."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        texts = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts, ends, first = X.words(data, off, X.ALNUM)
        low = X.lower(data)
        hashes = X.range_hash(X.prefix_hash(low), starts, ends)
        self.vocab, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.letters = low
        self.spelt = np.stack([starts[at], ends[at] - starts[at]], 1)
        self.items = [i for i, _ in items]
        self.words = ids.astype(np.uint32) + np.uint32(1)
        self.first = first
        seen = np.zeros(1 << 16, bool)
        seen[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.seen = seen
        self.window = window
        n = np.diff(first)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in sorted(set(np.minimum(n[n > 0], window).tolist())):
            mine = np.flatnonzero(np.minimum(n, window) == m)
            sizes = n[mine] - m + 1
            at, item = X.ragged(first[mine], sizes), np.repeat(mine, sizes)
            keys = suffix_keys(self.words, at, m)
            distinct, which = np.unique(keys, return_inverse=True)
            order = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which[order], np.arange(len(distinct) + 1))
            self.by_length[m] = (distinct, bounds, item[order], (at - first[item])[order])
        end = np.repeat(first[1:], n)
        self.left = end - np.arange(len(end))
        self.array = _suffix_array(self.words, self.left, np.flatnonzero(np.repeat(n >= window, n)))
        self.sums = _sums(self.words)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of the words, 0 for any other word."""
        out = np.zeros(len(hashes), np.uint32)
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(self.vocab):
            at = np.minimum(np.searchsorted(self.vocab, hashes[maybe]), len(self.vocab) - 1)
            out[maybe] = np.where(self.vocab[at] == hashes[maybe], at + 1, 0)
        return out


def suffix_keys(numbers: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The m words from each position as one string that sorts as the words do."""
    if not len(at):
        return np.zeros(0, f"S{4 * m}")
    return np.ascontiguousarray(sliding_window_view(numbers, m)[at].astype(">u4")).view(f"S{4 * m}").ravel()


def _suffix_array(words: np.ndarray, left: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes at these places, each ending with its item (left: words to go), in order; by doubling the length that is sorted."""
    rank = words.astype(np.int64)
    length, most = 1, int(left[at].max(initial=0))
    while length < most:
        after = np.zeros(len(rank), np.int64)
        inner = np.flatnonzero(left > length)
        after[inner] = rank[inner + length]
        _, rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)
        rank += 1
        length *= 2
    return at[np.argsort(rank[at], kind="stable")]


def _sums(numbers: np.ndarray) -> np.ndarray:
    up, _ = X.powers(len(numbers) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(numbers.astype(np.uint64)) * up[: len(numbers)], dtype=np.uint64)])


def _shared(sums: np.ndarray, at: np.ndarray, tests: TestSuffixes, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that the text from each position has in common with the test suffix at each place, at most so many."""
    _, down = X.powers(max(len(sums), len(tests.sums)))
    low, high = np.zeros(len(at), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[at + mid] - sums[at]) * down[at] == (tests.sums[place + mid] - tests.sums[place]) * down[place]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def longest_from(tests: TestSuffixes, numbers: np.ndarray, at: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each position, the length of its longest verbatim match in a long item: the better of its neighbours among the sorted test suffixes."""
    sums, array = _sums(numbers), tests.array
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(array))
    while (low < high).any():
        mid = np.minimum((low + high) // 2, len(array) - 1)
        place = array[mid]
        most = np.minimum(run, tests.left[place])
        n = _shared(sums, at, tests, place, most)
        i, j = np.minimum(at + n, len(numbers) - 1), np.minimum(place + n, len(tests.words) - 1)
        above = np.where(n < most, numbers[i] > tests.words[j], run > tests.left[place]) & (low < high)
        low, high = np.where(above, mid + 1, low), np.where(above | (low >= high), high, mid)
    best = np.zeros(len(at), np.int64)
    for k in (low - 1, low):
        place = array[np.clip(k, 0, len(array) - 1)]
        best = np.maximum(best, _shared(sums, at, tests, place, np.minimum(run, tests.left[place])))
    return best


def search(tests: TestSuffixes, numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple, np.ndarray]]:
    """For each window length: (length, matched word positions, number of the matching key, the keys' tables, known words from each position on)."""
    stop = np.unique(np.concatenate([np.flatnonzero(numbers == 0), first[1:], [len(numbers)]]))
    known = np.flatnonzero(numbers)
    run = stop[np.searchsorted(stop, known, "right")] - known if len(known) else known
    for m, table in tests.by_length.items():
        suffixes = known[run >= m]
        if not len(suffixes):
            continue
        keys = suffix_keys(numbers, suffixes, m)
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        low = np.searchsorted(array, table[0], "left")
        high = np.searchsorted(array, table[0], "right")
        found = np.flatnonzero(high > low)
        pick = order[X.ragged(low[found], (high - low)[found])]
        yield m, suffixes[pick], np.repeat(found, (high - low)[found]), table, run[run >= m][pick]


def shard_words(tests: TestSuffixes, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(vocabulary numbers of the shard's words, each document's first word, what ``search`` finds); words of matches are held against the vocabulary's bytes."""
    starts, ends, first = X.words(data, off, X.ALNUM)
    low = X.lower(data)
    numbers = tests.numbers(X.range_hash(X.prefix_hash(low), starts, ends))
    while True:
        found = list(search(tests, numbers, first))
        inside = np.unique(np.concatenate([np.zeros(0, np.int64), *(X.ragged(at, np.full(len(at), m)) for m, at, *_ in found)]))
        spelt = tests.spelt[numbers[inside].astype(np.int64) - 1]
        size = ends[inside] - starts[inside]
        wrong = size != spelt[:, 1]
        even = np.flatnonzero(~wrong)
        differ = low[X.ragged(starts[inside][even], size[even])] != tests.letters[X.ragged(spelt[even, 0], size[even])]
        wrong[np.repeat(even, size[even])[differ]] = True
        if not wrong.any():
            return numbers, first, found
        numbers[inside[wrong]] = 0


def shard_hits(tests: TestSuffixes, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Per document: word count; (first word, hit mask) of the shard; distinct (document, item) pairs; (length, word) of the first longest match."""
    numbers, first, found = shard_words(tests, data, off)
    edge = np.zeros(len(numbers) + 1, np.int32)
    pairs: set[tuple[int, int]] = set()
    longest: dict[int, tuple[int, int]] = {}
    for m, at, key, (_, bounds, item, _), run in found:
        np.add.at(edge, at, 1)
        np.add.at(edge, at + m, -1)
        doc = np.searchsorted(first, at, "right") - 1
        for d, k in np.unique(np.stack([doc, key]), axis=1).T.tolist():
            pairs.update((d, i) for i in item[bounds[k] : bounds[k + 1]].tolist())
        size = longest_from(tests, numbers, at, run) if m == tests.window else np.full(len(at), m)
        order = np.lexsort((at, -size, doc))
        for i in order[np.unique(doc[order], return_index=True)[1]].tolist():
            d = int(doc[i])
            longest[d] = _longer(longest.get(d), (int(size[i]), int(at[i] - first[d])))
    return np.diff(first), first, np.cumsum(edge[:-1]) > 0, sorted(pairs), longest


def _longer(a: tuple[int, int] | None, b: tuple[int, int]) -> tuple[int, int]:
    return b if a is None or (b[0], -b[1]) > (a[0], -a[1]) else a


def _runs(mask: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the true runs."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).astype(np.int32)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark in parts that each fit a fixed number of bytes."""
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = named.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).first()["b"] or 0
    n = max(1, -(-int(size) // block_bytes))
    return [named if n == 1 else named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


FOUND = {"n_words": "long", "spans": "binary", "items": "array<string>", "longest": "long", "longest_word": "long"}


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of docs as a struct ``row`` beside n_words, spans (int32 pairs of hit word runs), items (sorted item ids), longest (words) and longest_word (where it starts)."""
    spark = docs.sparkSession
    X.small_batches(spark)
    rows = X.wrapped(docs, "text")
    parts = blocks(benchmark, block_bytes)
    if len(parts) == 1:
        shared = _tests(parts[0], window)
        return rows.mapInArrow(X.lean(lambda batches: (_scan(b, shared.value, False) for b in batches)), X.with_fields(rows.select("row"), **FOUND))
    # a row is known by two hashes of its id and text: equal rows have equal hits
    rows = rows.withColumn("k1", F.xxhash64("row.doc_id", "text")).withColumn("k2", F.xxhash64("text", "row.doc_id", F.lit(1)))
    keys = rows.select(F.struct("k1", "k2").alias("row"), "text")
    scratch = X.Scratch(spark)
    found = []
    for part in parts:
        shared = _tests(part, window)
        hits = keys.mapInArrow(X.lean(lambda batches, shared=shared: (_scan(b, shared.value, True) for b in batches)), X.with_fields(keys.select("row"), **FOUND))
        found.append(scratch.saved(hits.dropDuplicates(["row"])))
        shared.destroy()
    # a row has one entry for each block that it holds a window of
    hits = scratch.saved(reduce(DataFrame.union, found).groupBy("row.k1", "row.k2").agg(F.collect_list(F.struct(*FOUND)).alias("parts")))
    scratch.done(last=1)

    def joined(batches):
        for b in batches:
            data, off = X.column(b, "text")
            _, _, first = X.words(data, off, X.ALNUM)
            got = [_united(n, p or []) for n, p in zip(np.diff(first).tolist(), b.column(2).to_pylist(), strict=True)]
            yield _found(b.column(0), list(zip(*got, strict=True)) or [()] * 5)

    out = rows.join(hits, ["k1", "k2"], "left").select("row", "text", "parts")
    return out.mapInArrow(X.lean(joined), X.with_fields(rows.select("row"), **FOUND))


def _tests(part: DataFrame, window: int) -> Broadcast[TestSuffixes]:
    return part.sparkSession.sparkContext.broadcast(TestSuffixes([(r["item_id"], r["text"]) for r in part.collect()], window))


def _found(row: pa.Array, cols: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([row, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["row", *FOUND])


def _scan(batch: pa.RecordBatch, tests: TestSuffixes, only_hits: bool) -> pa.RecordBatch:
    data, off = X.column(batch, "text")
    n = len(off) - 1
    n_words, spans, items, longest, where = [0] * n, [b""] * n, [[] for _ in range(n)], [0] * n, [None] * n
    for at, to in X.slices(off, SHARD_BYTES):
        count, first, mask, pairs, best = shard_hits(tests, *X.fit(data, off, at, to))
        n_words[at:to] = count.tolist()
        for d, i in pairs:
            if tests.items[i] is not None:
                items[at + d].append(tests.items[i])
        for d, (size, word) in best.items():
            longest[at + d], where[at + d] = size, word
            spans[at + d] = _runs(mask[first[d] : first[d + 1]]).tobytes()
    items = [sorted(set(x)) for x in items]
    out = _found(batch.column(0), [n_words, spans, items, longest, where])
    return out.filter(pa.array([x > 0 for x in longest], pa.bool_())) if only_hits else out


def _united(n: int, parts: list[dict]) -> tuple:
    best = None
    for p in parts:
        best = _longer(best, (p["longest"], p["longest_word"]))
    return n, _union([p["spans"] for p in parts], n), sorted({i for p in parts for i in p["items"]}), best[0] if best else 0, best[1] if best else None


def _union(parts: list[bytes], n: int) -> bytes:
    if not parts:
        return b""
    mask = np.zeros(n, bool)
    for s, e in np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2).tolist():
        mask[s:e] = True
    return _runs(mask).tobytes()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_word.

    Words are lower-cased (A-Z) runs of digits, letters and characters beyond
    ASCII. A window is ``window`` consecutive words of an item, or all words of
    a shorter item; document words inside any occurrence of a window are hit.
    longest is the length in words of the longest verbatim match that holds a
    window (0 without any) and longest_word the word where the first such
    starts (null without any). Null and empty texts have no words and hit
    nothing; an empty benchmark marks nothing; the windows of items without an
    id hit, but such items are neither counted nor listed; repeated rows and
    repeated items are each judged alone. Other columns are ignored.
    """
    marked = with_hits(docs.select("doc_id", "text"), benchmark, window, block_bytes)

    def digest(batches):
        for b in batches:
            spans, items = b.column(2).to_pylist(), b.column(3).to_pylist()
            hit = [int(np.diff(np.frombuffer(s, np.int32).reshape(-1, 2), axis=1).sum()) if s else 0 for s in spans]
            sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), b.column(4), b.column(5)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.select("row.doc_id", *FOUND).mapInArrow(X.lean(digest), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a verbatim match of a window, all their columns kept as they are; ``contamination`` says what counts."""
    return with_hits(docs, benchmark, window, block_bytes).where("longest = 0").select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Maximal verbatim matches of at least a window: doc_id, item_id, doc_word, item_word, n_words (positions from 0)."""
    spark = docs.sparkSession
    X.small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def located(part: DataFrame) -> DataFrame:
        shared = _tests(part, window)

        def task(batches):
            for b in batches:
                data, off = X.column(b, "text")
                ids = b.column(0)
                for at, to in X.slices(off):
                    rows = _maximal(shared.value, *X.fit(data, off, at, to))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0] + at)), pa.array([shared.value.items[i] for i in rows[1].tolist()], pa.string()), *(pa.array(c) for c in rows[2:])], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        return docs.select("doc_id", "text").mapInArrow(X.lean(task), f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")

    return reduce(DataFrame.unionByName, [located(p) for p in blocks(benchmark, block_bytes)])


def _maximal(tests: TestSuffixes, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Neighbouring window matches on one diagonal joined into the longest verbatim match."""
    _, first, found = shard_words(tests, data, off)
    out = [np.zeros((0, 5), np.int64)]
    for m, at, key, (_, bounds, item, item_at), _ in found:
        sizes = (bounds[1:] - bounds[:-1])[key]
        row = X.ragged(bounds[:-1][key], sizes)
        pos, it, ip = np.repeat(at, sizes), item[row], item_at[row]
        doc = np.searchsorted(first, pos, "right") - 1
        dp = pos - first[doc]
        order = np.lexsort((dp, dp - ip, it, doc))
        doc, it, dp, ip = doc[order], it[order], dp[order], ip[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (it[1:] != it[:-1]) | (dp[1:] != dp[:-1] + 1) | (ip[1:] != ip[:-1] + 1)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(doc))) + m - 1
        out.append(np.stack([doc[begin], it[begin], dp[begin], ip[begin], length], 1))
    return list(np.concatenate(out).T.copy())
