"""Shared-folder tables and text helpers used by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the corpus operators: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is missing, a temporary folder stands in on a single machine; on a cluster that raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="veilspark-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


_applications: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's part of the shared folder, which goes when the driver's Python ends."""
    app = f"{shared_dir(spark)}/veilspark/{spark.sparkContext.applicationId}"
    if app not in _applications:
        _applications.add(app)
        atexit.register(_tidy, spark, app)
    return f"{app}/{name}-{uuid.uuid4().hex}"


def _tidy(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        drop_path(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote, once nothing reads them any more, and with them the shuffle files of finished steps."""
    for t in tables:
        drop_path(t.sparkSession, t.stored_at)
    release(tables[0].sparkSession)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which it does when the driver's heap is collected.

    A table that was written holds its step's files as long as a variable of the caller holds it.
    """
    for _ in range(3):  # events about the step hold it for a moment, and its files go a moment after it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, where the C library can: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words as UTF-8: bytes.lower and bytes.split touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores after it as it takes to be no column's, whatever their case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_zstd = threading.local()  # contexts are costly to make and serve one thread


def pack(values: np.ndarray) -> bytes:
    """A numeric array as compressed byte planes."""
    if not hasattr(_zstd, "pack"):
        _zstd.pack = zstandard.ZstdCompressor(level=1)
    a = np.ascontiguousarray(values)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a.view(np.uint8)
    return _zstd.pack.compress(np.ascontiguousarray(planes).data if len(a) else b"")


def unpack(data: bytes, dtype) -> np.ndarray:
    if not hasattr(_zstd, "unpack"):
        _zstd.unpack = zstandard.ZstdDecompressor()
    raw = np.frombuffer(_zstd.unpack.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    out = np.empty((len(raw) // size, size), np.uint8)
    for i, plane in enumerate(raw.reshape(size, -1)):
        out[:, i] = plane
    return out.view(dtype).reshape(-1)


def pack_ints(values: np.ndarray) -> bytes:
    """Signed 64-bit numbers, non-negative ones in the narrowest type that holds them, as compressed byte planes."""
    a = np.ascontiguousarray(values, np.int64)
    low, top = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    width = 8 if low < 0 else next(w for w in (1, 2, 4, 8) if top < 1 << min(8 * w, 63) or w == 8)
    return bytes([width]) + pack(a.astype(f"<u{width}") if width < 8 else a)


def unpack_ints(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"<u{data[0]}" if data[0] < 8 else np.int64).astype(np.int64)
