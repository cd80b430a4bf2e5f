"""Helpers shared by the training-data operators: reading tables, shared storage, packed rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of
    its own; on a cluster that is an error, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores behind them where a table already has such a column (in any case of letters)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


#: A key that more than one in so many rows have is hot.
HOT_SHARE = 1000


def join_to_one(rows: DataFrame, ones: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with ``ones``, which has one row for each key and in column ``count`` the number of rows of that key; total is
    the sum of these numbers or more.

    Keys that hold more than total / HOT_SHARE of all rows are fewer than HOT_SHARE whatever the data, so theirs is a broadcast of
    proven size and their rows are not shuffled; all others meet by shuffle.
    """
    least = total / HOT_SHARE
    hot = F.broadcast(ones.where(F.col(count) > least))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(ones.where(F.col(count) <= least), keys)
    return rows.join(hot, keys).unionByName(cold)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that the shuffle's compression finds the constant high bytes."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).reshape(-1)


def split_by(bucket: np.ndarray, *columns: np.ndarray):
    """Yield (bucket, rows of each column) for each bucket that occurs, rows in their given order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    ends = np.append(starts[1:], len(bucket)) if len(bucket) else []
    columns = [c[order] for c in columns]
    for a, b in zip(starts, ends):
        yield int(bucket[a]), [c[a:b] for c in columns]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def empty_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def partition_keys(spark: SparkSession, width: int) -> list[int]:
    """For each of width partitions one integer that repartition(width, key) deals to it, so that packed rows spread evenly."""
    keys = spark.range(width * 24).select(F.col("id").cast("int").alias("k"))
    found = keys.groupBy(F.expr(f"pmod(hash(k), {width})").alias("p")).agg(F.min("k").alias("k")).collect()
    at = {r["p"]: r["k"] for r in found}
    spare = next(iter(at.values()))
    return [at.get(p, spare) for p in range(width)]


class RollingHash:
    """64-bit polynomial hashes of any stretch of a byte buffer, by differences of one running sum."""

    def __init__(self, most: int, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        self.letter = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._grow(most)

    def _grow(self, most: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(most, self.base, dtype=np.uint64))))
            self.back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(most, self.inverse, dtype=np.uint64))))
        self.most = most

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.most:
            self._grow(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.letter[data] * self.power[: len(data)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((sums[end] - sums[start]) * self.back[start])

    def fixed(self, sums: np.ndarray, width: int) -> np.ndarray:
        """The hash of each stretch of width bytes, by start."""
        n = len(sums) - width
        with np.errstate(over="ignore"):
            return mix64((sums[width:] - sums[:n]) * self.back[:n])


def text_chunks(texts: list, most: int = 1 << 21):
    """Cut a list of byte strings into (first, last) ranges of about most bytes; one longer text is a range by itself."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def release() -> None:
    """Hand freed memory back to the system: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, rows: int = 1024):
    """Arrow batches in slices of some rows, so that what Python makes of them stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    release()
