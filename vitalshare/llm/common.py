"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vitalshare.sources.writers import new_folder

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, grouped by ``keys``, stored in the shared folder in as many buckets of the keys
    as shuffles have partitions: joins by the keys then move only their other side."""
    spark = df.sparkSession
    name = f"clustered_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, *keys).format("parquet")
    writer.option("path", f"{new_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def with_text(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """The columns kept and the text, which goes to the workers once, and the text's place."""
    if "text" in keep and docs.schema["text"].dataType == StringType():
        return docs.select(*keep), keep.index("text")
    return docs.select(*keep, F.col("text").cast("string").alias("_text")), len(keep)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of a value written as text, modulo ``modulus``; NULL stays NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


_HELD: list[dict] = []


def held() -> dict:
    """A dict that outlasts a task of this worker, until one begins that has no use for it."""
    _HELD.append({})
    return _HELD[-1]


def trim(*used: dict) -> None:
    """Empties what earlier tasks of this worker ``held`` but for the dicts used, and gives
    memory they freed back to the system, where the allocators can: workers are reused, and what
    one stage left over adds to the next's peak."""
    for kept in _HELD:
        if not any(kept is x for x in used):
            kept.clear()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes of text, whole rows, in order."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return ranges(size, limit)


def ranges(size: np.ndarray, limit: int):
    """Row ranges whose sizes add up to about ``limit``, one row at least, in order."""
    end = np.cumsum(size.astype(np.int64))
    start, n = 0, len(size)
    while start < n:
        before = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, before + limit, side="right")))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def room(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n items, doubled as needed."""
    if n <= len(array):
        return array
    more = np.empty(max(n, 2 * len(array)), array.dtype)
    more[: len(array)] = array
    return more
