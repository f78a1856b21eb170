"""Reading vector columns batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(rows: DataFrame, column: str) -> int:
    """The number of entries that most vectors have, the larger one in a tie; 0 without any."""
    sizes = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("k"))
    first = sizes.orderBy(F.desc("k"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold `dim` finite entries, and those rows as doubles."""
    right = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == dim
    flat = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = flat.reshape(-1, dim)
    finite = np.isfinite(found).all(axis=1)
    good = right.copy()
    good[right] = finite
    return good, found[finite]
