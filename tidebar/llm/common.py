"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts may have a hundred thousand characters; a task holds a few batches at a time on both sides.
BATCH_ROWS = "500"


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch than Spark's default, which is meant for narrow rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that the driver and every executor share; it goes when the application ends.

    Where the session names none, a local folder serves a local master (tests); on a cluster that is an error."""
    small_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidebar-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/tidebar-{spark.sparkContext.applicationId}"
    if path not in _announced:
        _announced.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return path


_announced: set[str] = set()


#: Tables written between two collections of the driver's garbage.
TIDY = 4
_written = 0


def tidy(spark: SparkSession) -> None:
    """Drop the plans of tables that are done with. An operator of many rounds makes dozens, and the driver's JVM, which sees none of the
    Python objects that hold them, would otherwise take its whole heap before it looks."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    global _written
    _written += 1
    if _written % TIDY == 0:
        tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nobody reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kid, ktx, text): a row's key is its id and 63 bits of its text's hash, so repeated rows share a key, and so do their results. The
    lowest bit of ktx is set where there is no id; kid is a second hash of the text then."""
    text, ident = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    ktx = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(ident.isNull().cast("long"))
    return docs.select(F.coalesce(ident, F.xxhash64(F.lit("no id"), text)).alias("kid"), ktx.alias("ktx"), text.alias("text"))


def id_of(kid: int, ktx: int) -> int | None:
    return None if ktx & 1 else kid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes, so that memory does not follow the number of long texts in a batch."""
    for batch in batches:
        n, size = batch.num_rows, max(1, batch.nbytes)
        step = max(1, int(n * limit / size))
        for at in range(0, n, step):
            yield batch.slice(at, step)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xC2B2AE3D27D4EB4F
_powers: list[np.ndarray] = []


def _powers_of_base(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (n + 1 places); the array has no nulls."""
    texts = texts.cast(pa.large_binary())
    where = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[where[0] : where[-1]] if held is not None and len(held) else np.empty(0, np.uint8)
    return data, where - where[0]


def word_places(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: their begins and ends among the bytes, and the number of words before each text (n + 1)."""
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[where] = True
    after, before = np.concatenate([[False], full[:-1]]), np.concatenate([full[1:], [False]])
    begin = np.flatnonzero(full & (~after | edge[:-1]))
    end = np.flatnonzero(full & (~before | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, where)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word by its bytes alone: differences of prefix polynomial hashes, moved to one power."""
    power, inverse = _powers_of_base(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        return mix((prefix[end] - prefix[begin]) * inverse[begin])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open intervals as maximal runs; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo, hi)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(int(a), int(b)) for a, b in out]
