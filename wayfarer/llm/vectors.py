"""Shared parts of the vector operators: which vectors count, and packed matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector and all of its components are present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a float64 matrix."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1).astype(np.float64)
