"""What the operators share: the cluster's shared folder, row keys, whole-text byte scans."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local run (tests) gets one of its own; a cluster is refused."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


#: The folder of the run that is now open, if one is: scratch() opens it.
_run: ContextVar[str | None] = ContextVar("llm_run", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """A folder for what stored() writes until the block ends, when it is deleted: results that read it must be written by then.

    Outside of such a block each operator's tables stay, as its lazy result reads them; nobody else deletes them.
    """
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folder(spark: SparkSession, what: str) -> str:
    """A new path for a table, in the open run's folder or in the shared one."""
    return f"{_run.get() or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = folder(spark, what)
    # the shuffles behind a stored table are not needed any more; Spark deletes their files once the driver's JVM has
    # seen that, which it can do when the events of the job that wrote it have passed: so before the next one, too
    spark._jvm.java.lang.System.gc()
    df.write.option("compression", compression).parquet(path)
    spark._jvm.java.lang.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave, once what was made of them is stored itself."""
    for t in tables:
        remove(t.sparkSession, t._stored_at)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows while the block runs, for jobs whose rows are megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keyed(docs: DataFrame, *, th: str = "_th") -> DataFrame:
    """Adds _th, the hash of the text. (doc_id, _th) names a document: equal rows are one document, equal ids with other texts are not."""
    return docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))


def same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_th"] == b["_th"])


def text_of(docs: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


# --- whole-text scans over Arrow buffers -------------------------------------------------


def byte_slices(texts: pa.Array, most: int = 2_000_000):
    """(first row, end row, bytes, offsets) of consecutive rows with about `most` bytes; a longer text comes alone and whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64, count=texts.offset + n + 1)[texts.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i])
        i = j


def trim() -> None:
    """Gives freed memory of this Python worker back; workers live on from task to task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche 64-bit mixer (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words beyond this many bytes are hashed one by one.
_LONG = 64


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, 8 bytes a step through a full mixer; seeds give independent hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    n = end - start
    h = mix64(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1))
    who, at, left = slice(None), start, n
    while len(at):
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        h[who] = mix64(h[who] ^ part) + np.uint64(0xD6E8FEB86659FD93)
        more = (left > 8) & (left <= _LONG if isinstance(who, slice) else True)
        if not more.any():
            break
        who = np.flatnonzero(more) if isinstance(who, slice) else who[more]
        at, left = at[more] + 8, left[more] - 8
    long = np.flatnonzero(n > _LONG)
    if len(long):
        import xxhash

        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[s:e], seed=seed) for s, e in zip(start[long].tolist(), end[long].tolist())]
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        m = max(n, 500_064)
        for k, b in (("p", _BASE), ("i", _INV)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] a polynomial of data[:i] modulo 2^64; span_hash gives windows their values."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for data[start:end]: equal bytes give equal values wherever they stand. Texts can be made whose values clash, so this orders windows and names nothing."""
    if not len(start):
        return np.zeros(0, np.uint64)
    inv = powers(len(h))[1]
    return mix64((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _lut(inside) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[b for b in range(256) if inside(b)]] = True
    return t


#: Bytes of a word [^\x20\x09-\x0D]+, and of one made of letters, digits and all bytes beyond ASCII.
SPACED = _lut(lambda b: b != 32 and not 9 <= b <= 13)
LETTERS = _lut(lambda b: chr(b).isalnum() if b < 128 else True)


def word_spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each text (one more entry at the end). Words don't cross texts."""
    n = len(data)
    w = np.zeros(n + 1, bool)
    w[:n] = inside[data]
    first = w[:n].copy()
    first[1:] &= ~w[: n - 1]
    last = w[:n] & ~w[1:]
    cuts = offs[:-1][offs[:-1] < n]
    first[cuts] = w[cuts]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = w[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that they need no path of the driver's; makes Arrow batches small."""
    import os
    import zipfile

    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # rows are whole texts
    if getattr(sc, "_llm_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="llm-package-"), "llm_package.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(os.listdir(here)):
            if f.endswith(".py"):
                z.write(os.path.join(here, f), f"llm/{f}")
    sc.addPyFile(name)
    sc._llm_shipped = True
