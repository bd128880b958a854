"""Shared folders, sizes and compact row groups for the text operators."""

from __future__ import annotations

import atexit
import ctypes
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator; it sorts before all others.
NULL_ID = -(2**63)


#: This process's tables in the shared folder.
_RUN = f"run-{uuid.uuid4().hex}"


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="gridloom-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{workspace(df.sparkSession)}/gridloom/{_RUN}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this process has stored, and no others'; frames that still read from them fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{workspace(spark)}/gridloom/{_RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    if spark is not None:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001  the session is going away
            pass


def parts(df: DataFrame, mb: float = 8.0) -> int:
    """Groups to deal df's rows into: its planned size over mb, but no fewer than the shuffle partitions; those where the size is not known."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = 0 if size > 1 << 56 else size
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, int(size / (mb * 1e6))))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long (null: NULL_ID), the text's UTF-8 bytes, and the columns asked for; nothing else."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def group_of_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(id), n) of longs, as Spark finds it."""
    raw = ids.astype("<i8").tobytes()
    h = np.fromiter((xxhash.xxh64_intdigest(raw[i : i + 8], 42) for i in range(0, len(raw), 8)), np.uint64, len(ids))
    return (h.view(np.int64) % n).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value: dtype and length of each, then their bytes."""
    head = b"".join(struct.pack("<3sq", a.dtype.str[:3].encode(), len(a)) for a in arrays)
    return struct.pack("<B", len(arrays)) + head + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, at = blob[0], 1 + 11 * blob[0]
    out = []
    for i in range(n):
        kind, size = struct.unpack_from("<3sq", blob, 1 + 11 * i)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4" if top < 2**32 else "<u8")


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of each run of equal keys."""
    if len(keys):
        cut = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
            yield int(keys[a]), a, b


def ranges(df: DataFrame, mb: float = 16.0) -> int:
    """Ranges to deal df's rows into: by its planned size, but four for each shuffle partition at least."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(df, mb))


def id_bounds(ids: DataFrame, n: int) -> list[int]:
    """The least id of each of up to n ranges with about as many rows each, from the column doc_id alone."""
    first = ids.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least"))
    return sorted({r.least for r in first.collect()})  # one a range


def range_of(key: Column, bounds: list[int]) -> Column:
    """The index of the last bound that is not above the key, by binary search."""
    steps = [1 << k for k in range(max(1, len(bounds).bit_length()) - 1, -1, -1)]
    table = bounds_table(bounds)
    higher = lambda lo, s: F.coalesce(F.get(table, lo + s) <= key, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(higher(lo, s), lo + s).otherwise(lo))


def bounds_table(bounds: list[int]) -> Column:
    return F.lit(bounds).cast("array<long>") if bounds else F.array(F.lit(NULL_ID))


def small_side(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df, marked for a broadcast if it has no more than so many rows; otherwise the join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def meet(rows: DataFrame, side: DataFrame, on: str, weight: str, how: str = "inner", few: int = 20_000) -> DataFrame:
    """rows joined to side, whose column `weight` says how many rows each of its distinct keys has.

    A side of few rows goes to every task. Of a larger one only the keys with over a ten-thousandth of all rows do (ten
    thousand at most); the other keys are small and meet by key, so no key lands in one task.
    """
    if side.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(side.drop(weight)), on, how)
    heavy = F.col(weight) > (side.agg(F.sum(weight)).first()[0] or 0) / 10_000
    hot, rest = F.broadcast(side.where(heavy).drop(weight)), side.where(~heavy).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(rest, on, how))


def trim() -> None:
    """Gives freed memory back to the system: workers idle beside a stage that needs none of theirs."""
    try:
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run, keeps: bool = False):
    """A map over batches that lets go of what its worker held for other operators, and of freed memory at its end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _HELD.clear()
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


_HELD: dict = {}


def held(key, make):
    """A large object that a Python worker keeps from task to task; making another one lets it go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
