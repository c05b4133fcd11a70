"""Byte-level helpers the text operators share: Arrow columns in, numpy arrays out.

Texts are handled as the UTF-8 bytes of an Arrow string column. A batch is cut
into slices of whole documents (``slices``) so that work arrays stay small
whatever the batch holds; one document is never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.session import ship

SLICE_BYTES = 1 << 20
#: a batch of rows ends at the first of both, so its weight is bounded whatever a text weighs
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_U64 = np.uint64
_P = _U64(0x9E3779B97F4A7C15)
_P_INV = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = [_U64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(32)]
_BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: digits, letters and every byte of a character beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = True
ALNUM[128:] = True
#: everything but blank, tab, line feed, vertical tab, form feed, carriage return
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can weigh, the same way for every operator, and see that executors have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one in a local session; on a cluster, an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="wardline-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What is run within leaves no shuffle files on the executors' disks: without this they stay until the driver happens to collect garbage."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


class Scratch:
    """Tables kept while an operator runs; ``done`` gives their room back."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._kept: list[DataFrame] = []
        self._folders: list[str] = []

    def kept(self, df: DataFrame) -> DataFrame:
        """The table kept on the executors' disks for its several readers, with its lineage: what an executor takes with it is computed anew."""
        self._kept.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def saved(self, df: DataFrame, *by: str) -> DataFrame:
        """As ``cut``, in Parquet, in a folder for each value of the columns named: for texts, which are then compressed."""
        to = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        with _shuffles_dropped(self.spark):
            df.write.partitionBy(*by).parquet(to) if by else df.write.parquet(to)
        self._folders.append(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def done(self, last: int = 0) -> None:
        """Release all kept tables, and delete all folders but the ``last`` ones."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while len(self._folders) > last:
            path = jvm.org.apache.hadoop.fs.Path(self._folders.pop(0))
            path.getFileSystem(conf).delete(path, True)


def wrapped(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as one struct ``row``, beside the columns asked for: what an operator adds can then clash with nothing."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def with_fields(df: DataFrame, **added: str) -> T.StructType:
    """df's schema and the added columns, for a mapInArrow."""
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def release() -> None:
    """Give memory that numpy and Arrow have freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(task):
    """The task of a mapInArrow, leaving no freed memory behind."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def one_row_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that repeat a key are one document: the smallest text stands.

    The test reads the key column only; texts are grouped only if a key does
    repeat. A row without a key takes no part.
    """
    df = df.select(key, value).where(F.col(key).isNotNull())
    if df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty():
        return df
    return df.groupBy(key).agg(F.min(value).alias(value))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    a = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(a.type):
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
        width = np.int64
    else:
        width = np.int32
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = a.buffers()
    off = np.frombuffer(offs, width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if a.null_count:
        valid = np.asarray(a.is_valid())
        if (np.diff(off)[~valid] > 0).any():  # a null may still own bytes
            parts = [raw[off[i] : off[i + 1]] for i in np.flatnonzero(valid)]
            sizes = np.where(valid, np.diff(off), 0)
            return np.concatenate(parts or [raw[:0]]), np.concatenate([[0], np.cumsum(sizes)])
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of documents whose bytes stay near the limit."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to
        at = to


def fit(data: np.ndarray, off: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    return data[off[at] : off[to]], off[at : to + 1] - off[at]


class _Powers:
    """Powers of the hash base and of its inverse, as far as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([[_U64(1)], np.full(m - 1, b, np.uint64)]), dtype=np.uint64) for b in (_P, _P_INV))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    return _powers.get(n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U64(31))
    h *= _U64(0x7FB5D329728EA185)
    h ^= h >> _U64(27)
    h *= _U64(0x81DADEF4BC2DD44D)
    h ^= h >> _U64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[i] the weighted sum of the first i bytes; see ``range_hash``."""
    up, _ = _powers.get(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: equal bytes give equal hashes wherever they stand."""
    _, down = _powers.get(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each document's first word (one entry more than documents)."""
    n = len(data)
    is_word = kind[data]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    cut = off[:-1][off[:-1] < n]
    before[cut] = False
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word after A-Z is lower-cased, and each document's first word."""
    starts, ends, first = words(data, off, kind)
    return range_hash(prefix_hash(lower(data)), starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a document, and each document's first run.

    A document of fewer than k words, but not none, has its whole sequence as one run.
    """
    n_words = np.diff(first)
    n_runs = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    doc_first = np.concatenate([[0], np.cumsum(n_runs)])
    doc = np.repeat(np.arange(len(n_words)), n_runs)
    at = first[:-1][doc] + (np.arange(len(doc)) - doc_first[doc])
    full = (n_words >= k)[doc]
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(len(doc), np.uint64)
    for j in range(k):
        term = padded[at + j] * _Q[j]
        if not full.all():
            term = np.where(full | (j < n_words[doc]), term, _U64(0))
        out += term
    out += np.where(full, k, n_words[doc]).astype(np.uint64)
    return mix(out), doc_first


def strings(values: list[bytes | None]) -> pa.Array:
    return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values], pa.string())


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes first[i], first[i]+1, ... of all runs, end to end."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)
