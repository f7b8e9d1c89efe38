"""Helpers shared by the corpus operators: the shared work folder, table reads, and word and byte arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 1 << 20


def work_dir(spark: SparkSession) -> str:
    """A new folder path under spark.checkpoint.dir; a temporary folder only where that setting is unset on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheafcalc-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sheafcalc-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = folder or work_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of stored tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_folder", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def sampled(id_col: str, share: float) -> Column:
    """Whether an id falls into a sample of this share: the least hashes of 53 bits, one step of them at least."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 11)
    return hashed < F.lit(max(1, int(share * (1 << 53))))


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a side of a counted size; beyond the limit Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that are over (their results have been stored)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rested(spark: SparkSession) -> None:
    """Let executors give back the heap that earlier steps made them take: a full collection shrinks it, and until then all of
    it counts beside the Python workers of the next step. Several tasks for each core, so that every executor gets some."""
    release(spark)
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


# --- arrays inside tasks -------------------------------------------------------------------------


def give_back() -> None:
    """Return freed memory to the system. Python workers live on from task to task and from stage to stage; what Arrow and the
    C library keep of it counts against the executor all the while."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def lean(f: Callable) -> Callable:
    """A function of Arrow batches, of a group or of two groups, that gives back what it has freed when it is done."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    def of_group(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    def of_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return of_batches if isgeneratorfunction(f) else of_group if len(signature(f).parameters) == 1 else of_groups


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, one text after another, and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    kind = np.int64 if large else np.int32
    at = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `limit` bytes each; a longer text is a slice of its own."""
    _, at = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
BYTE_WORDS = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("b", ())) < n:
        size = max(n, CHUNK_BYTES + 64)
        for k, b in (("b", _BASE), ("i", _UNBASE)):
            p = np.full(size, U64(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["b"][:n], _powers["i"][:n]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many ranges at once, equal for equal bytes wherever they stand."""
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_WORDS[data] * p[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64) * U64(0x9FB21C651E98DF25))


def spans(data: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each maximal run of bytes that in_word (a table of 256) marks; runs end with their text."""
    w = in_word[data]
    if not len(w):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(len(w) + 1, bool)
    first[at] = True
    begins = w.copy()
    begins[1:] &= ~w[:-1] | first[1:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | first[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(at, s, "right") - 1


#: Bytes of words that white space ends: all but 0x20 and 0x09 to 0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
