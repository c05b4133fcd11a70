"""Quality from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each text. Their
votes are counted by pattern over all texts, and expectation-maximisation over
the patterns (a fixed number, whatever the corpus) estimates how often each
labeller is right. The posterior of a text's pattern is its weak label. A
linear scorer over hashed word shapes is then trained on the posteriors of a
bounded sample of texts and scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import textops as X

#: name, statistic, bad below, good from, good to, bad above (None: no such side)
LABELLERS = (
    ("repeated_words", "distinct_share", 0.25, None, None, None),
    ("top_word", "top_share", None, None, None, 0.25),
    ("repeated_pairs", "pair_share", 0.4, None, None, None),
    ("symbols", "symbol_share", None, None, None, 0.05),
    ("capitals", "capital_share", None, None, None, 0.3),
    ("digits", "digit_share", None, None, None, 0.2),
    ("repeated_lines", "line_share", 0.5, None, None, None),
    ("word_length", "word_bytes", 2.0, None, None, 16.0),
    ("plain_signs", "symbol_share", None, 0.0, 0.02, None),
    ("sentences", "stop_share", None, 0.02, 0.4, None),
)
STATISTICS = ("distinct_share", "top_share", "pair_share", "symbol_share", "capital_share", "digit_share", "line_share", "word_bytes", "stop_share", "n_words")
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 24 << 20
BUCKETS = 1 << 14
ROUNDS = 60

#: classes of bytes for word shapes: letters, capitals, digits, beyond ASCII, and each other sign itself
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?-()" for b in range(256)])
_CAPITAL = np.array([65 <= b < 91 for b in range(256)])
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 or b >= 192 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_LINE = np.ones(256, bool)
_LINE[10] = False


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: number of distinct hashes and the count of the commonest; per hash: met earlier in the document."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, doc))
    a, d = h[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(a)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], size)
    again = np.empty(len(h), bool)
    again[order] = ~new
    return np.bincount(d[at], minlength=n), most, again


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; shares of nothing are 0 or, for distinct ones, 1; fewer than ten words have no top word."""
    h, first = X.word_hashes(data, off, X.ALNUM)
    n = np.diff(first)
    distinct, most, _ = _distinct(h, first)
    pairs, pf = X.shingles(h, first, 2)
    lines, lf = X.word_hashes(data, off, _LINE)
    size = np.maximum(1, np.diff(off))
    letters = np.maximum(1, _per_doc(_LETTER[data], off))

    def share(part: np.ndarray, whole: np.ndarray, none: float) -> np.ndarray:
        return np.where(whole > 0, part / np.maximum(1, whole), none)

    # a long text repeats its words more: distinct words are held against the square root law
    expected = np.minimum(n, 12 * np.sqrt(np.maximum(1, n)))
    return np.stack([np.minimum(1, share(distinct, expected, 1.0)), np.where(n >= 10, share(most, n, 0.0), 0.0), share(_distinct(pairs, pf)[0], np.diff(pf), 1.0), _per_doc(_SYMBOL[data], off) / size, _per_doc(_CAPITAL[data], off) / letters, _per_doc(_DIGIT[data], off) / size, share(_distinct(lines, lf)[0], np.diff(lf), 1.0), share(_per_doc(X.ALNUM[data], off), n, 0.0), share(_per_doc(data == 46, off), n, 0.0), n.astype(float)], 1)


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 abstains; a column for each labeller. A text without words is bad to all that can say so."""
    out = np.zeros((len(stats), len(LABELLERS)), np.int8)
    empty = stats[:, STATISTICS.index("n_words")] == 0
    for k, (_, name, bad_lo, good_lo, good_hi, bad_hi) in enumerate(LABELLERS):
        x = stats[:, STATISTICS.index(name)]
        bad = np.zeros(len(x), bool)
        if bad_lo is not None:
            bad |= x < bad_lo
        if bad_hi is not None:
            bad |= x > bad_hi
        good = (x >= good_lo) & (x <= good_hi) & ~empty if good_lo is not None else np.zeros(len(x), bool)
        out[good, k], out[bad | (empty & (bad_lo is not None or bad_hi is not None)), k] = 1, -1
    return out


@dataclass
class LabelModel:
    prior: float
    #: for each labeller, chances of bad, abstain, good, given bad (row 0) and good (row 1)
    chances: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that texts with these votes are good."""
        logit = np.full(len(v), np.log(self.prior) - np.log1p(-self.prior))
        for k in range(v.shape[1]):
            logit += (np.log(self.chances[k, 1]) - np.log(self.chances[k, 0]))[v[:, k] + 1]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def accuracies(self) -> list[float]:
        """How often each labeller is right when it votes."""
        right = self.prior * self.chances[:, 1, 2] + (1 - self.prior) * self.chances[:, 0, 0]
        wrong = self.prior * self.chances[:, 1, 0] + (1 - self.prior) * self.chances[:, 0, 2]
        return (right / (right + wrong)).tolist()


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Fit on vote patterns and how often each occurs; starts from a vote in which one bad outweighs the goods."""
    k = patterns.shape[1]
    if not len(patterns):
        return LabelModel(0.5, np.full((k, 2, 3), 1 / 3))
    good = np.where((patterns == -1).any(1), 0.1, 0.95)
    model = None
    for _ in range(rounds):
        prior = float(np.clip((counts @ good) / counts.sum(), 0.01, 0.99))
        chances = np.zeros((k, 2, 3))
        for j in range(k):
            for vote in (-1, 0, 1):
                mine = patterns[:, j] == vote
                chances[j, 1, vote + 1] = (counts * good)[mine].sum()
                chances[j, 0, vote + 1] = (counts * (1 - good))[mine].sum()
            # one vote of smoothing, towards labellers that are right
            chances[j] += np.array([[1.0, 0.5, 0.1], [0.1, 0.5, 1.0]])
        chances /= chances.sum(2, keepdims=True)
        model = LabelModel(prior, chances)
        now = model.posterior(patterns)
        done = np.abs(now - good).max() < 1e-9
        good = now
        if done:
            break
    return model


def hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, document bounds): shapes of words, of neighbouring pairs, and words met before."""
    shape, first = X.word_hashes(_SHAPE[data], off, X.NONSPACE)
    word, _ = X.word_hashes(data, off, X.NONSPACE)
    pairs, pf = X.shingles(shape, first, 2)
    again = X.mix(np.minimum(3, _distinct(word, first)[2]).astype(np.uint64) + np.uint64(1))
    n, m = np.diff(first), np.diff(pf)
    bounds = np.concatenate([[0], np.cumsum(2 * n + m)])
    out = np.empty(bounds[-1], np.int64)
    for part, at, size in ((shape, bounds[:-1], n), (again, bounds[:-1] + n, n), (pairs, bounds[:-1] + 2 * n, m)):
        out[X.ragged(at, size)] = (X.mix(part) % np.uint64(BUCKETS)).astype(np.int64)
    return out, bounds


def _means(weights: np.ndarray, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.diff(np.concatenate([[0.0], np.cumsum(weights[features])])[bounds])
    return total / np.maximum(1, np.diff(bounds))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        features, bounds = hashed(data, off)
        return 1 / (1 + np.exp(-np.clip(_means(self.weights, features, bounds) + np.where(np.diff(bounds) > 0, self.bias, -4.0), -40, 40)))


def train_scorer(data: np.ndarray, off: np.ndarray, target: np.ndarray, rounds: int = ROUNDS) -> Scorer:
    """Logistic regression on posteriors as soft labels; each side weighs alike."""
    if not len(target):
        return Scorer(np.zeros(BUCKETS), 0.0)
    features, bounds = hashed(data, off)
    size = np.maximum(1, np.diff(bounds))
    doc = np.repeat(np.arange(len(target)), np.diff(bounds))
    each = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    each /= each.sum()
    w, bias = np.zeros(BUCKETS), 0.0
    mom, sq, mb, sb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(_means(w, features, bounds) + bias, -40, 40)))
        slope = each * (p - target)
        g = np.bincount(features, weights=(slope / size)[doc], minlength=BUCKETS) + 1e-6 * w
        gb = slope.sum()
        mom, sq, mb, sb = 0.9 * mom + 0.1 * g, 0.99 * sq + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.3 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * mom / (np.sqrt(sq) + 1e-8)
        bias -= rate * mb / (np.sqrt(sb) + 1e-8)
    return Scorer(w, float(bias))


def vote_table(docs: DataFrame) -> DataFrame:
    """doc_id and the votes (a string of 0 bad, 1 abstain, 2 good, one sign a labeller) of every row."""
    X.small_batches(docs.sparkSession)

    def task(batches):
        for b in batches:
            data, off = X.column(b, "text")
            for at, to in X.slices(off):
                v = votes(statistics(*X.fit(data, off, at, to)))
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], X.strings([(r + 49).astype(np.uint8).tobytes() for r in v])], names=["doc_id", "votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(X.lean(task), f"doc_id {kind}, votes string")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[LabelModel, Scorer]:
    """The label model from all texts' votes, the scorer from a sample of at most sample_rows texts and sample_bytes bytes.

    The sample is the texts with the least hash, of any length; one that would take the sample over its bytes is left out.
    """
    counted = vote_table(docs).groupBy("votes").count().collect()  # 3 ** len(LABELLERS) rows at most
    patterns = np.array([[int(c) - 1 for c in r["votes"]] for r in counted], np.int8).reshape(-1, len(LABELLERS))
    model = expectation_maximisation(patterns, np.array([r["count"] for r in counted], float))
    share = int((1 << 30) * min(1.0, 4 * sample_rows / max(1, sum(r["count"] for r in counted))))  # so that each task sends few
    drawn = docs.select("text", F.octet_length("text").alias("size"), F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("place")).where((F.col("size") > 0) & (F.col("place") < share))
    total, picked = 0, []
    for r in drawn.select("place", "size").orderBy("place", "size").limit(sample_rows).collect():
        if total + r["size"] <= sample_bytes:
            total += r["size"]
            picked.append((r["place"], r["size"]))
    wanted = sorted({p for p, _ in picked})
    rows = drawn.where(F.col("place").isin(wanted) & (F.col("size") <= max((s for _, s in picked), default=0))).orderBy("place", "size", "text").limit(len(picked)).collect() if picked else []
    raw = [r["text"].encode() for r in rows]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return model, train_scorer(data, off, model.posterior(votes(statistics(data, off))))


def with_quality(docs: DataFrame, fitted: tuple[LabelModel, Scorer] | None = None) -> DataFrame:
    """Each row of docs as a struct ``row`` beside votes, posterior and score of its text."""
    spark = docs.sparkSession
    X.small_batches(spark)
    shared = spark.sparkContext.broadcast(fitted or fit(docs.select("doc_id", "text")))
    rows = X.wrapped(docs, "text")

    def task(batches):
        model, scorer = shared.value
        for b in batches:
            data, off = X.column(b, "text")
            for at, to in X.slices(off):
                part = X.fit(data, off, at, to)
                v = votes(statistics(*part))
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], X.strings([(r + 49).astype(np.uint8).tobytes() for r in v]), pa.array(model.posterior(v)), pa.array(scorer.scores(*part))], names=["row", "votes", "posterior", "score"])

    return rows.mapInArrow(X.lean(task), X.with_fields(rows.select("row"), votes="string", posterior="double", score="double"))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, votes, posterior, score (0 to 1, higher: better), kept (score >= 0.5).

    Null and empty texts have no features and score below a half; repeated
    rows score alike; an empty table gives no rows. Other columns are ignored.
    """
    out = with_quality(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "votes", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def good_documents(docs: DataFrame, at: float = 0.5) -> DataFrame:
    """The documents that score at least the limit, all columns as they are: null and empty texts go, rows without an id are judged by their text."""
    return with_quality(docs, fit(docs.select("doc_id", "text"))).where(F.col("score") >= at).select("row.*")
