"""Shared helpers: tables, the shared staging folder, shipping of the package, byte-level word scanning."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import cluster

#: Used only where the session names no shared folder (local tests).
LOCAL_SHARED = "/tmp/checkpoints/tessera"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return path or LOCAL_SHARED


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera-stage/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes the folder that stage() wrote df to, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files and "/tessera-stage/" in files[0]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that Spark gathers for one Arrow batch; long texts times Spark's own row count would take far more.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, and bounds the session's Arrow batches in bytes where they aren't bounded as low."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    cluster.ship(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs that are over: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: mallopt's M_MMAP_THRESHOLD, and the bytes from which an array is mapped on its own.
MMAP_THRESHOLD, MAPPED_BYTES = -3, 1 << 20
_LEAN: list[bool] = []


def lean() -> None:
    """Larger arrays, Arrow's too, go back to the system as soon as they are freed: Python workers outlive their tasks."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # only where the C library is glibc
        if mallopt:
            mallopt(MMAP_THRESHOLD, MAPPED_BYTES)


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def held_out(id_col: str = "doc_id"):
    """Remainder 2 is held out; a null id is not."""
    return F.coalesce(fold_of(id_col) == 2, F.lit(False))


# --- byte-level scanning of Arrow string columns -------------------------------------------------


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null counts as empty."""
    lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = 2 << 20):
    """Row ranges of at most limit bytes, or of one row: bounds the memory that a batch needs."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of BASE and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for k, b in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_sums(data: np.ndarray) -> np.ndarray:
    """What span_hashes sums up, for several calls on the same data."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], equal for equal bytes."""
    down = _powers(len(data) + 1)[1]
    sums = span_sums(data) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Maximal runs of bytes of the class inside, none across rows: hash, start, end and row of each, in order.

    data: bytes; offsets: of the rows, from 0; inside: 256 booleans.
    """
    is_in = inside[data]
    n = len(data)
    if not n or not is_in.any():
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    first, last = is_in.copy(), is_in.copy()
    first[1:] &= ~is_in[:-1]
    last[:-1] &= ~is_in[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = is_in[inner]
    last[inner - 1] = is_in[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return span_hashes(data, starts, ends), starts, ends, rows


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are parted by white space 0x20, 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII digits, a-z and all that is not ASCII.
WORD_CHAR = np.zeros(256, bool)
WORD_CHAR[0x30:0x3A] = WORD_CHAR[0x61:0x7B] = WORD_CHAR[0x80:] = True
