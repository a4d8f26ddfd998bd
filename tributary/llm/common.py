"""Pieces shared by the training-data operators.

Storage: intermediate tables go to the folder named in ``spark.checkpoint.dir``
(a folder of our own is set only where that is unset, as in tests).
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents aims at: least and most. Blocks grow with the root of the corpus, so that
#: messages between blocks and buckets grow in proportion to it; the most is what a Python worker can hold several times over.
BLOCK_BYTES = 8 << 20
MOST_BLOCK_BYTES = 128 << 20
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where both are one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts the lineage.

    The table is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    to = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(to)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(to)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text modulo folds; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def release() -> None:
    """Gives a worker's freed memory back to the machine, since the process outlives its task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, compared without case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


#: A key counts as hot above this many rows and above this share of all rows, so there are at most 10,000 hot keys.
HOT_ROWS = 64
HOT_SHARE = 10_000


def joined_by_size(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left joined with right, which holds each key once and in ``size`` its number of rows in left (total in all).

    Rows of hot keys meet a broadcast of the at most HOT_SHARE hot rows of right, so they stay where they are; the
    others are shuffled, no more than one row in HOT_SHARE to a key. Both sides are read twice: stash them first.
    A key that is null meets nothing.
    """
    hot = F.col(size) > max(HOT_ROWS, total // HOT_SHARE)
    few, rest = F.broadcast(right.where(hot).drop(size)), right.where(~hot).drop(size)
    return left.join(few, key).unionByName(left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(rest, key))


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """(doc_id, no_id, text, block), the bytes of all texts and the number of blocks, which follows them.

    pandas would make longs with nulls floating, so a null doc_id is the largest long with no_id set.

    A block is a bounded group of whole documents, drawn by a hash of the row and of its input partition,
    so copies of a document, equal rows too, spread over blocks. One long document is never cut.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = block_bytes or min(max(BLOCK_BYTES, math.isqrt(total * 80_000)), MOST_BLOCK_BYTES)
    n = max(1, -(-total // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64), F.spark_partition_id()), F.lit(n))), total, n


# --- rolling hashes over arrays, modulo 2**64 --------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a polynomial hash reaches every other."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any slices of an array from one pass of prefix sums.

    The hash of a[i:j] is sum(v[a[k]] * base**(k - i)); base is odd and thus has
    an inverse modulo 2**64, which turns slices into differences of prefixes.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = np.uint64(int(rng.integers(1 << 62, dtype=np.int64)) * 8 + 5 & (1 << 64) - 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                up, down = np.full(n, self.base), np.full(n, self.inverse)
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        """values: uint8, looked up in the table, or uint64 as they are."""
        n = len(values)
        self._powers(n + 1)
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        with np.errstate(over="ignore"):
            v = self.table[values] if values.dtype == np.uint8 else values
            np.cumsum(v * self.up[:n], out=out[1:])
        return out

    def slices(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefixes[end] - prefixes[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        """Hashes of slices in order, taken in pieces of the data, so that a very long text needs no more memory than its bytes."""
        cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data) + 1, piece)), len(start)))
        parts = [np.zeros(0, np.uint64)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            base = start[i]
            parts.append(self.slices(self.prefixes(data[base : end[j - 1]]), start[i:j] - base, end[i:j] - base))
        return np.concatenate(parts)
