"""What the operators share: word splitting, hashing, tables in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Those six characters as a plain string, for ``translate`` and ``trim``.
SPACE_CHARS = " \t\n\x0b\x0c\r"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: What tasks leave in a worker for later tasks of their kind, by name.
KEPT: dict = {}


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def release() -> None:
    """Hand memory that isn't in use any more back to the system, Arrow's and the allocator's: workers wait beside the stages that use none."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def drop_kept() -> None:
    """Empty ``KEPT``. All stages share the workers, and what tasks of one kind left would stand beside the work of others."""
    KEPT.clear()


def tidied(run: Callable) -> Callable:
    """``run`` for ``applyInArrow``, a function of two arguments, without what other tasks have kept; memory goes back to the system after each group."""

    def tidy(a, b):
        drop_kept()
        try:
            return run(a, b)
        finally:
            release()

    return tidy


def tidied_batches(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, without what other tasks have kept; memory goes back to the system after the last batch."""

    def tidy(batches):
        drop_kept()
        yield from run(batches)
        release()

    return tidy


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six characters of ``SPACE``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text: Column) -> Column:
    """Number of words of a text column, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one if that is unset in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="barwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stash(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing that was written."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python at most so many rows at once in this session: what a worker holds follows it. A smaller setting stays, so plans that are chained keep what each asks for."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def unused(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that none of ``columns`` has."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def hash_words(vocabulary: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of 64-bit values; products wrap around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Interner(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def intern_words(texts: list[str | None], lower: bool = False) -> tuple[Interner, np.ndarray, np.ndarray]:
    """Vocabulary of some texts, the word numbers of all of them in a row, and the word count of each text."""
    table = Interner()
    look = table.__getitem__
    rows, lengths = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            raw = text.encode("utf-8", "surrogatepass")
            got = (raw.lower() if lower else raw).split()
            lengths[k] = len(got)
            rows.append(np.fromiter(map(look, got), np.int32, len(got)))
    return table, np.concatenate(rows) if rows else np.zeros(0, np.int32), lengths


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every ``n`` consecutive values: the sum of ``values[i + k] * B**(n - 1 - k)``.

    Spans double in length at each step, so it takes about ``log2(n)`` passes over the array.
    """
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out, done, power, span, base = None, 0, values, 1, MULTIPLIER
    # ``power`` hashes spans of ``span`` values, ``base`` is B**span.
    while span <= n:
        if n & span:
            size = len(values) - n + 1
            if out is None:
                out = power[n - span : n - span + size].copy()
                scale = base
            else:
                out = power[n - done - span : n - done - span + size] * scale + out
                scale = scale * base
            done += span
        if span * 2 > n:
            break
        power = power[:-span] * base + power[span:]
        base = base * base
        span *= 2
    return out


def scale_partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as a number of buckets that follows the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
