"""Arrow functions that hold a stretch of a batch as Python values, never all of it.

Spark's batches have thousands of rows of whatever length, and a worker that turns one into Python values at once takes many
times its bytes. Here only the columns, in and out, are whole; values are made and dropped a stretch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes and rows that are Python values at once.
STRETCH_BYTES, STRETCH_ROWS = 1 << 20, 4096


def stretches(sizes: np.ndarray, most: int = STRETCH_BYTES, rows: int = STRETCH_ROWS) -> Iterator[tuple[int, int]]:
    """(first, count) of stretches that hold at most ``most`` by the sizes and at most ``rows`` rows, or one row."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), at + rows)
        yield at, end - at
        at = end


def by_value(kind: T.DataType, value_of: Callable):
    """A UDF of texts that gives ``value_of`` each of them."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def made(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        parts = [pa.array([value_of(t) for t in texts.slice(at, n).to_pylist()], arrow) for at, n in stretches(sizes)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return made
