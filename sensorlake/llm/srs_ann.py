"""Approximate nearest neighbours by stable projections and an incremental kd-tree search.

Vectors are projected on a few Gaussian (2-stable) directions; a kd-tree over the
projections gives the rows in the order of their projected distance, leaf by leaf, and
each is verified with the original vectors. For a row at distance d the squared projected
distance over d^2 has a chi-square distribution. So once the next projected distance is
beyond the ``confidence`` quantile for the k-th best distance found, a better row is
unlikely to remain, and the search stops.

Every row is indexed: blocks of rows carry a tree each, blocks of queries are searched in
each of them, and the best are merged. The nearness is the largest inner product; rows get
one more component so that it is also the smallest distance.

Defined cases: vectors that are null, zero or hold null or non-finite components take no
part; shorter vectors count as filled with zeros; a query never meets rows of its own id,
and repeated (id, vector) rows count once; fewer than k candidates are all returned, as the
test holds only after k rows; empty tables give an empty result; equal scores go to the
smaller id. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.vectors import best, lifted, matrix, merge_best


def chi_square_quantile(p: float, m: int) -> float:
    """The value below which a chi-square variable with ``m`` (even) degrees lies with
    probability ``p``."""
    if m % 2 or not 0 < p < 1:
        raise ValueError("an even number of projections and 0 < confidence < 1, please")

    def cdf(x: float) -> float:
        term = total = math.exp(-x / 2)
        for j in range(1, m // 2):
            term *= x / 2 / j
            total += term
        return 1 - total

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Positions of the points in each leaf of a kd-tree split at medians of the widest axis."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        axis = int(np.ptp(points[at], axis=0).argmax())
        order = at[np.argpartition(points[at, axis], len(at) // 2)]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q``, summed component by component, so that
    equal rows get equal scores wherever they stand."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * q[d]
    return s


def search_block(k: int, dims: int, top: float, projections: int, stop: float, leaf: int, seed: int):
    plane = np.random.default_rng(seed).standard_normal((dims + 1, projections))

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            ids, x, q = rows["vec_id"].to_numpy(), matrix(rows["v"], dims), matrix(queries["v"], dims)
            qids, q2 = queries["vec_id"].to_numpy(), np.einsum("ij,ij->i", q, q)
            px, pq = lifted(x, top) @ plane, q @ plane[:dims]
            leaves = kd_leaves(px, leaf)
            lo, hi = np.array([px[a].min(axis=0) for a in leaves]), np.array([px[a].max(axis=0) for a in leaves])
            ahead = np.stack([(np.maximum(np.maximum(lo - p, p - hi), 0) ** 2).sum(axis=1) for p in pq])
            order = ahead.argsort(axis=1, kind="stable")
            ahead = np.take_along_axis(ahead, order, axis=1)
            # The k best distances of each query so far, and what was verified with its score.
            kept = np.full((len(q), k), np.inf)
            seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qids]
            active = np.arange(len(q))
            for step in range(len(leaves)):
                limit = kept[active, -1] * (1 + 1e-9) + 1e-12 * (top + 1)
                active = active[~(ahead[active, step] > stop * limit)]
                if not len(active):
                    break
                here = order[active, step]
                for l in np.unique(here):
                    at, who = leaves[l], active[here == l]
                    scores = q[who] @ x[at].T
                    d2 = np.maximum(q2[who][:, None] + top - 2 * scores, 0)
                    d2[qids[who][:, None] == ids[at][None]] = np.inf
                    nearest = np.partition(np.hstack([kept[who], d2]), k - 1, axis=1)[:, :k]
                    nearest.sort(axis=1)
                    kept[who] = nearest
                    limit = nearest[:, -1] * (1 + 1e-9) + 1e-12 * (top + 1)
                    for w, near, most in zip(who, d2, limit, strict=True):
                        if (good := np.flatnonzero((near <= most) & (near < np.inf))).size:
                            seen[w].append((at[good], near[good]))
            for w, parts in enumerate(seen):
                if not parts:
                    continue
                at, near = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                at = at[near <= kept[w, -1] * (1 + 1e-9) + 1e-12 * (top + 1)]
                s = exact_scores(x[at], q[w])
                found = best(s, ids[at], k)
                out["query_id"] += [qids[w]] * len(found)
                out["vec_id"] += ids[at[found]].tolist()
                out["score"] += s[found].tolist()
        return pd.DataFrame(
            {c: np.array(v, dtype="float64" if c == "score" else "int64") for c, v in out.items()}
        )

    return search


def srs_neighbours(
    rows: DataFrame,
    is_query: Column,
    k: int,
    projections: int = 8,
    confidence: float = 0.95,
    leaf: int = 128,
    queries_per_block: int = 1024,
    rows_per_block: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """Up to ``k`` near rows of each query: query_id, rank, vec_id, score (inner product).

    rows: vec_id long, v array<double>. is_query: a condition on ``vec_id``. ``confidence``
    is the chance that the stopping test keeps a row which belongs to the result."""
    spark = rows.sparkSession
    rows = (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
        .where(F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0))
        .distinct()
    )
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total = rows.agg(
        F.count("*").alias("n"),
        F.count(F.when(is_query, 1)).alias("queries"),
        F.max(F.size("v")).alias("dims"),
        F.max(norm2).alias("top"),
    ).first()
    schema = "query_id long, vec_id long, score double"
    if not total["queries"]:
        return merge_best(spark.createDataFrame([], schema), k)
    row_blocks, query_blocks = -(-total["n"] // rows_per_block), -(-total["queries"] // queries_per_block)

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    indexed = rows.select("vec_id", "v", own(row_blocks).alias("row_block"), every(query_blocks).alias("query_block"))
    asked = rows.where(is_query).select(
        "vec_id", "v", every(row_blocks).alias("row_block"), own(query_blocks).alias("query_block")
    )
    keys = ["row_block", "query_block"]
    stop = chi_square_quantile(confidence, projections)
    found = (
        indexed.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(
            search_block(k, total["dims"], float(total["top"]), projections, stop, leaf, seed), schema
        )
    )
    return merge_best(found, k)
