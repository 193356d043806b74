"""Helpers shared by the two vector searches: cleaning, reduction of inner products to
distances, and blocks of queries against blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vec: str):
    """True where the vector is not null and every component is present and finite."""
    bad = F.exists(
        F.col(vec),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """The vectors of a column as rows of one array; shorter ones are filled with zeros."""
    out = np.zeros((len(column), dims))
    if len(column) and all(len(v) == dims for v in column):
        out[:] = np.stack(column.to_numpy()) if dims else 0
    else:
        for i, v in enumerate(column):
            out[i, : len(v)] = v
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with one more component, so that all have the length sqrt(``top``): for a query
    q (with 0 appended) |q - x|^2 = |q|^2 + top - 2 q.x, so the largest inner product is
    the smallest distance."""
    rest = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))
    return np.hstack([x, rest[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of ``a`` and of ``b``."""
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, highest first, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = np.flatnonzero(scores >= kth)
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


def merge_best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all blocks, with their rank from 1. Spark keeps k
    rows a query in every task before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
