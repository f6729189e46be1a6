"""Vector functions: Arrow kernels for scoring against few queries, native aggregates for centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that have the dimension and no null entry, and which rows they are of."""
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lens == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = np.isfinite(flat).all(1)
    return flat[whole], rows[whole]


def score(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Similarity of a vector column to one query: cosine, dot, or l2 (the distance).

    Null for null vectors, vectors of another length or with null or infinite entries; for cosine
    also for the zero vector.
    """
    q = np.asarray(query, np.float64)
    norm = float(np.linalg.norm(q))

    @arrow_udf("double")
    def kernel(v: pa.Array) -> pa.Array:
        out = np.full(len(v), np.nan)
        if len(v):
            x, rows = matrix(v, len(q))
            if metric == "l2":
                out[rows] = np.sqrt(((x - q) ** 2).sum(1))
            elif metric == "dot":
                out[rows] = x @ q
            else:
                size = np.linalg.norm(x, axis=1) * norm
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[rows] = np.where(size > 0, (x @ q) / size, np.nan)
        return pa.array(out, pa.float64(), from_pandas=True)

    return kernel(vector)


def centroid(vector: Column, dim: int) -> Column:
    """The element-wise mean of a group's vectors, as plain averages: combined before the shuffle, nothing exploded."""
    return F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if one of them is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
