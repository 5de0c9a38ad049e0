"""Rows of vectors shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows whose vector is there and holds only finite numbers,
    components as doubles.  A vector without components is whole."""
    inf = F.lit(float("inf"))
    finite = F.forall("x", lambda v: F.coalesce((v < inf) & (v > -inf), F.lit(False)))
    return (vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
            .where(F.col("x").isNotNull() & finite))


def matrix(column, dims: int) -> np.ndarray:
    """A list column whose lists all have ``dims`` entries, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
