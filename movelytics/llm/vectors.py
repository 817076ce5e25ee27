"""Embeddings as whole numbers: what the operators over vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole(vectors: DataFrame, columns: list[str], vector_col: str = "embedding") -> DataFrame:
    """(columns, x): x is floor(256 * entry) of each entry, as long.

    Rows whose vector is null, has no entry, or holds a null or non-finite entry go. Entries beyond 2^55 have no defined result.
    """
    v = F.col(vector_col)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite))
    return kept.select(*columns, F.transform(v, lambda e: F.floor(e.cast("double") * SCALE)).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as a matrix of d columns; vectors of another length are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != d * len(column) or len(column) and (np.diff(column.offsets.to_numpy()) != d).any():
        raise ValueError(f"all vectors must have {d} entries")
    return flat.reshape(len(column), d)
