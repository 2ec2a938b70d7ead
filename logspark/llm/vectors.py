"""What the operators on vectors share: which rows take part, and whole-number components within bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held within this, plus and minus, after scaling: products and squares summed over thousands of components,
#: a hundredfold, fit 64 bits. Embeddings are a thousand times smaller; anything beyond counts as the limit.
LIMIT = 1 << 20


def usable(embedding: Column) -> Column:
    """Vectors without null, NaN or infinite components."""
    good = F.forall(embedding.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & good


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, within ``LIMIT``."""
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(
        F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix of 64-bit numbers."""
    if not len(column):
        return np.empty((0, 0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def commonest_length(rows: DataFrame, column: str) -> int | None:
    """The length most arrays of ``column`` have, the larger of equals; None without rows."""
    sizes = rows.groupBy(F.size(column).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("length")).first()
    return None if found is None else found["length"]
