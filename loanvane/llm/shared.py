"""What the corpus operators have in common: staged tables, key hashes, and hashing of words in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the corpus contracts; the same set of separators as bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60

_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


# ---------------------------------------------------------------- staged tables


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``); a local session without one gets its own."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="corpus-stage-")
    spark.conf.set("spark.checkpoint.dir", root)
    _delete_at_exit(spark, root)
    return root


def new_folder(spark: SparkSession, tag: str) -> str:
    """Path of a folder not yet made under the shared root; it goes when the application ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and lost executors cost nothing."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def give_back(*frames: DataFrame, shuffles: bool = True) -> None:
    """Delete the folders of staged tables that nothing reads any more, and let Spark drop the ``shuffles`` of finished jobs."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    if frames and shuffles:
        drop_shuffles(frames[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collector finds their jobs unreachable, which may be long after their last use: collect now."""
    spark._jvm.System.gc()


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def exchange_buckets(spark: SparkSession) -> int:
    """Buckets of a packed exchange: as many as the session's shuffles have partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs inside, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def size_checked(small: DataFrame, row_limit: int) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``row_limit`` rows, else as it is for a shuffled join.

    Give it staged, narrow tables of fixed row width: the row limit then bounds the bytes.
    """
    return F.broadcast(small) if small.limit(row_limit + 1).count() <= row_limit else small


# ---------------------------------------------------------------- expressions


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of a key's text, as a long; a null key hashes like the text ``null``."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of a key's text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(folds)


# ---------------------------------------------------------------- words in numpy


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _MULT if kind == "up" else _INVERSE
        steps = np.full(max(n, 2 * len(have)), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of words, word prefixes, suffixes and word runs of one text given as list of byte words.

    The words are joined by single blanks; a polynomial hash of any byte range follows from running sums.
    """

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        raw = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.starts = np.concatenate(([0], gaps + 1)) if words else np.zeros(0, np.int64)
        self.ends = np.concatenate((gaps, [len(raw)])) if words else np.zeros(0, np.int64)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[raw] * _power("up", len(raw)), out=self.sums[1:])
        self.down = _power("down", len(raw) + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.ranges(self.starts, self.ends)

    def runs(self, n: int) -> np.ndarray:
        """Hash of each run of ``n`` words; with fewer words, of all of them as one."""
        if len(self.starts) <= n:
            return self.ranges(self.starts[:1], self.ends[-1:])
        return self.ranges(self.starts[: len(self.starts) - n + 1], self.ends[n - 1 :])

    def prefixes(self, length: int) -> np.ndarray:
        """Hash of the first ``length`` bytes of the words that are longer."""
        longer = self.ends - self.starts > length
        return self.ranges(self.starts[longer], self.starts[longer] + length)

    def suffixes(self, length: int) -> np.ndarray:
        return self.ranges(np.maximum(self.starts, self.ends - length), self.ends)


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text, null as empty; lone surrogates, which no Spark string holds, are replaced."""
    return value.encode("utf-8", "replace") if value else b""


def release_memory() -> None:
    """Gives memory that a finished task freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def group_offsets(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))
