"""Shared parts of the training-data operators: tables cut from their lineage, size-checked broadcasts, samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.sources.tables import delete, importable, scratch

#: A side of a join is broadcast up to so many bytes, of its values and ROW_BYTES a row; larger ones are shuffled.
BROADCAST_BYTES, ROW_BYTES = 2_000_000, 24

_kept: list[Cut] = []


class Cut:
    """A table written to the shared folder and read again: later plans start there, on any executor, also after losses."""

    def __init__(self, df: DataFrame, name: str = "cut"):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _kept.append(self)

    def drop(self) -> None:
        """Only once no plan reads it any more; what is left goes with the interpreter."""
        if self in _kept:
            _kept.remove(self)
            delete(self.spark, self.path)


def clear() -> None:
    """Drops all tables of this kind: in a long session, once the results that were made from them are written."""
    for x in list(_kept):
        x.drop()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return Cut(df, name).df


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + 8 + _bytes(x, kind.elementType)), F.lit(0).cast("long"))
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
    return F.lit(8).cast("long")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values, which are counted, have at most `most` bytes, else as it is: then the join shuffles."""
    total = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    n = df.agg(F.sum(total)).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text is a multiple of 5; a null id counts as empty text (true)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, key: str, stratum: str, most: int, seed: int = 7) -> DataFrame:
    """At most `most` rows of each stratum, by the hash of `key`: the same rows in each run. Strata are few; null ones go.

    A threshold on the hash, from each stratum's count, keeps what is ranked near `most` rows at any size.
    """
    rank = F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 40) - 1))
    counts = df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()
    if not counts:
        return df.limit(0)
    limits = [(F.col(stratum) == F.lit(r[0])) & (rank < F.lit(int(min(1.0, (most + 6 * most**0.5) / r[1]) * (1 << 40)) + 1)) for r in counts]
    kept = limits[0]
    for x in limits[1:]:
        kept = kept | x
    from pyspark.sql import Window

    return df.where(kept).withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(rank, key))).where(F.col("_rank") <= most).drop("_rank")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Rows and bytes in an Arrow batch at most, from now on: long texts must fit a Python worker's memory. Workers must find this package.

    Plans read the session's settings when they run, so these stay lowered; a lower setting of the caller's own is left.
    """
    importable(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = (spark.conf.get(key) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Gives a Python worker's free memory back to the system: workers outlive their tasks, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def trimmed(f: Callable) -> Callable:
    """f, which yields batches, and trim() at its end."""

    @wraps(f)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return outer


def packed(counts: np.ndarray) -> bytes:
    """Rows of counts by the place of their bytes, so that the many zeros lie together, compressed; the size comes first."""
    data = np.ascontiguousarray(counts).view(np.uint8).reshape(-1, counts.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def unpacked(data: bytes, kind: type, rows: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    whole = pa.decompress(data[8:], n, "zstd", asbytes=True) if n else b""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(size, -1).T).view(kind).reshape(rows, -1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
