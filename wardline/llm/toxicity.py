"""Toxicity by compression distance.

Two zstandard dictionaries: the ordinary one is trained on windows of ordinary
text; the toxic one has the same content and then the segments that recur in
toxic text, in different surroundings, and hardly in ordinary text. Both explain
ordinary writing alike, so a window's compressed length falls from one to the
other by what is toxic in it. A text's windows give its largest fall, how
surprising the windows beyond each of several falls are at the rate of ordinary
windows, and their share; a logistic curve fitted on the training rows turns
these into a score, shifted so that a stated share of ordinary texts passes a half.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import textops as X

FOLDS = 5
WINDOW_WORDS = 8
HEAD_BYTES = 8
DICTIONARY_BYTES = 16 << 10
MIN_MATCH = 6
#: bounds of the labelled sample the dictionaries and the curve are fitted on, in rows and in bytes of text
TOXIC_ROWS = 1500
ORDINARY_ROWS = 3000
TOXIC_BYTES = 8 << 20
ORDINARY_BYTES = 12 << 20
#: a segment's least lift and log-likelihood excess in toxic text, and the shortest word beginning
LIFT = 8.0
EXCESS = 15.0
STEM_BYTES = 4
#: falls beyond which windows are counted, and the share of ordinary training texts that may score a half
FALLS = (0.0, 1.0, 2.0, 4.0)
FALSE_SHARE = 0.01
FEATURES = len(FALLS) + 4

#: begins every window and ends both dictionaries, so that no window is stored uncompressed
_PRIMER = b"0123456789 abcdefghijklmnopqrstuvwxyz 9876543210 zyxwvutsrqponmlkjihgfedcba"
#: ends every window: the last bytes of a block are never searched for matches
_TAIL = b"~=~+~^~|~"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def windows(text: bytes) -> list[bytes]:
    """The words, WINDOW_WORDS at a time, with a blank before and after.

    Words are lower-cased but for their first bytes, which stand in capitals:
    so a word's beginning never matches the inside of another word.
    """
    words = [w[:HEAD_BYTES].upper() + w[HEAD_BYTES:] for w in text.translate(_FOLD).split()]
    return [b"%b %b %b" % (_PRIMER, b" ".join(words[i : i + WINDOW_WORDS]), _TAIL) for i in range(0, len(words), WINDOW_WORDS)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: share of ordinary windows beyond each of FALLS
    rates: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _compressors(self):
        if "_pair" not in self.__dict__:
            self._pair = [_compressor(d) for d in (self.ordinary, self.toxic)]
        return self._pair

    def falls(self, wins: list[bytes]) -> np.ndarray:
        """How many bytes shorter each window gets with the toxic dictionary."""
        a, b = (c.compress for c in self._compressors())
        return np.fromiter((len(a(w)) - len(b(w)) for w in wins), np.float64, len(wins))

    def features(self, text: bytes) -> np.ndarray:
        fall = self.falls(windows(text))
        n = len(fall)
        if not n:
            return np.zeros(FEATURES)
        count = (fall[:, None] > np.array(FALLS)).sum(0)
        usual = n * self.rates
        surprise = np.where(count > usual, count * np.log(np.maximum(count, 1) / usual) - (count - usual), 0.0)
        k = count[1]
        return np.array([np.log1p(max(0.0, fall.max())), *np.sqrt(np.maximum(surprise, 0.0)), k / (n + 6), np.log(n), k > 0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = (np.array([self.features(t) for t in texts]) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Matches of MIN_MATCH bytes at least; so few literals are stored plain: lengths then differ by matches alone."""
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=MIN_MATCH, target_length=64, window_log=17, hash_log=17, chain_log=17, search_log=10, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how)


def _surroundings(texts: list[bytes]) -> tuple[Counter[bytes], int]:
    """In how many different surroundings each word and word beginning stands (copies of a text add nothing), and the number of words."""
    number: dict[bytes, int] = {}
    runs = []
    for t in texts:
        runs.append(np.array([0, *(number.setdefault(w, len(number) + 1) for w in t.translate(_FOLD).split()), 0], np.int32))
    triples = [np.stack([r[1:-1], r[:-2], r[2:]], 1) for r in runs]
    distinct = np.unique(np.concatenate([np.zeros((0, 3), np.int32), *triples]), axis=0)
    count = np.bincount(distinct[:, 0], minlength=len(number) + 1)
    seen: Counter[bytes] = Counter()
    for word, i in number.items():
        marked = word[:HEAD_BYTES].upper() + word[HEAD_BYTES:]
        seen[b" %b " % marked] += int(count[i])
        for n in range(STEM_BYTES, min(len(word), 2 * STEM_BYTES)):
            seen[b" " + marked[:n]] += int(count[i])
    return seen, sum(len(t) for t in triples) + 1


def _recurring(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Segments far likelier in toxic than in ordinary text, by the excess over a Poisson count; the likeliest last."""
    (bad, n_bad), (good, n_good) = _surroundings(toxic), _surroundings(ordinary)
    excess = {}
    for segment, n in bad.items():
        expected = n_bad * (good[segment] + 1) / n_good
        if n > LIFT * expected:
            gain = n * np.log(n / expected) - (n - expected)
            if gain > EXCESS:
                excess[segment] = gain
    kept: list[bytes] = []
    for segment in sorted(excess, key=lambda w: (-excess[w], -len(w), w)):
        if not any(len(k) > MIN_MATCH and segment.startswith(k.rstrip()) or k.startswith(segment) for k in kept):
            kept.append(segment)
    return kept[::-1]


def _ordinary_dictionary(texts: list[bytes]) -> bytes:
    samples = [w for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own text serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """The model of two lists of training texts; repeats count once."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    base = _ordinary_dictionary(ordinary)
    segments = b""
    for segment in reversed(_recurring(toxic, ordinary)):  # the likeliest nearest to the window, as many whole ones as there is room for
        if len(segment) + len(segments) > DICTIONARY_BYTES:
            break
        segments = segment + segments
    model = Model(base + _PRIMER, base + segments + _PRIMER, np.ones(len(FALLS)), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    falls = np.concatenate([model.falls(windows(t)) for t in ordinary] or [np.zeros(0)])
    model.rates = ((falls[:, None] > np.array(FALLS)).sum(0) + 1) / (len(falls) + 100)
    x = np.array([model.features(t) for t in [*toxic, *ordinary]]).reshape(-1, FEATURES)
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(ordinary))])
    if len(x):
        model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.weights = _logistic((x - model.centre) / model.scale, y)
    if toxic and ordinary:
        usual = np.quantile(((x - model.centre) / model.scale)[y == 0] @ model.weights[1:], 1 - FALSE_SHARE)
        model.weights[0] = -(usual + 1e-6)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood; with one label only, or none, a constant below or above a half."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 2.0 if len(y) and y[0] == 1 else -2.0
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    Documents are taken by the least hash(doc_id), whole and whatever their
    length, while rows and bytes of each label are within bounds; one that
    alone is over the bytes left is passed over. Null labels, null texts and
    labels without a document take no part.
    """
    X.small_batches(docs.sparkSession)
    marked = labels.select("doc_id", "toxic").where("toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    parts = []
    for label, n in ((1, toxic_rows), (0, ordinary_rows)):
        share = int((1 << 30) * min(1.0, 4 * n / max(1, there.get(label, 0))))  # so that each task sends few
        likely = marked.where((F.col("toxic") == label) & (place < share)).withColumn("place", place)
        parts.append(likely.orderBy("place", "doc_id").limit(2 * n))
    few = parts[0].union(parts[1])
    # ids are bounded by the rows asked for, so they are broadcast and no text is shuffled
    sizes = docs.join(F.broadcast(few), "doc_id").where("text is not null").groupBy("doc_id", "toxic", "place").agg(F.max(F.octet_length("text")).alias("size"))
    wanted: list[int] = []
    left = {1: [toxic_rows, TOXIC_BYTES], 0: [ordinary_rows, ORDINARY_BYTES]}
    for r in sorted(sizes.collect(), key=lambda r: (r["place"], str(r["doc_id"]))):
        room = left[r["toxic"]]
        if room[0] and r["size"] <= room[1]:
            wanted.append(r["doc_id"])
            room[0] -= 1
            room[1] -= r["size"]
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], T.StructType([T.StructField("doc_id", labels.schema["doc_id"].dataType)]))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").join(F.broadcast(few.select("doc_id", "toxic")), "doc_id").where("text is not null").select("toxic", "text").collect()
    return fit(*([r["text"].encode() for r in rows if r["toxic"] == label] for label in (1, 0)))


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of docs as a struct ``row`` beside its score, by the whole text; null and empty texts get the score of no windows."""
    spark = docs.sparkSession
    X.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = X.wrapped(docs, "text")

    def task(batches):
        for b in batches:
            data, off = X.column(b, "text")
            raw = data.tobytes()
            score = shared.value.scores([raw[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(X.lean(task), X.with_fields(rows.select("row"), score="double"))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Only the text is scored. Null and empty texts score as texts without
    windows; a null doc_id is not held out; repeated rows are scored alike;
    without any training rows every score is below a half. Other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text")
    scored = with_score(docs, train(docs, labels))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("row.doc_id", "score").select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The documents that score below the limit, all columns as they are; ``toxicity`` says how odd rows score."""
    return with_score(docs, train(docs.select("doc_id", "text"), labels)).where(F.col("score") < at).select("row.*")
