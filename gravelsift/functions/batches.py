"""Arrow batches of texts, cut so that a worker's memory doesn't grow with the table or its files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Whole texts of at most so many bytes (or one text) come to a worker in a batch, and become Python objects at once.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Let Arrow batches, which else hold 10,000 rows, hold at most BATCH_BYTES, for the session (by default the active one)."""
    spark = spark or SparkSession.getActiveSession()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and (not (now := spark.conf.get(key).rstrip("b")).isdigit() or int(now) > BATCH_BYTES):
        spark.conf.set(key, BATCH_BYTES)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows whose texts have at most `most` bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    sums, k = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while k < len(texts):
        n = max(1, int(np.searchsorted(sums, sums[k] + most, side="right")) - 1 - k)
        yield k, n
        k += n


def by_slices(make: Callable[..., pa.Array], texts: pa.Array, *others: pa.Array) -> pa.Array:
    """make(texts, *others) slice by slice, as one array."""
    parts = [make(texts.slice(k, n), *(x.slice(k, n) for x in others)) for k, n in slices(texts)]
    return pa.concat_arrays(parts) if parts else make(texts, *others)
