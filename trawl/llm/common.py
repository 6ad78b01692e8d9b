"""What the operators of this subpackage share: reading, shared scratch, splits, batches of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trawl.sources.tables import cut_lineage, shared_checkpoints, table

__all__ = ["SLICE_BYTES", "cut_lineage", "mix64", "ragged", "remainder", "shared_checkpoints", "slices", "small_batches", "table", "texts"]

#: Bytes of text that a task turns into Python objects at once.
SLICE_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on tasks get texts in Arrow batches of at most SLICE_BYTES, on either side of the Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) not in (str(SLICE_BYTES), f"{SLICE_BYTES}b"):
        spark.conf.set(key, str(SLICE_BYTES))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null keys count as -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values in the column stay near the limit of bytes."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i in a row."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(starts - firsts, lengths) + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
