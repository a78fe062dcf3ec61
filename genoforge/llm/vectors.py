"""Vectors as whole numbers, for operators that must give exact sums and products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str, limit: float) -> Column:
    """The vector is there, and so is each component, finite and under the limit; NaN is above every number."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < limit)), F.lit(False))


def scaled(vector: str, scale: int, shift: int = 0) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int, missing: int = 0) -> np.ndarray:
    """Rows of whole numbers; vectors shorter than `dimensions` are continued with `missing`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(column)
    sizes = np.diff(column.offsets.to_numpy())
    if len(flat) == n * dimensions and (sizes == dimensions).all():
        return flat.reshape(n, dimensions)
    out = np.full((n, dimensions), missing, np.int64)
    out[np.arange(dimensions) < sizes[:, None]] = flat
    return out
