"""Exact top-k search as a Voronoi kNN join.

Queries and rows are grouped by their nearest pivot. A summary of each cell (its radius
and the distances of its k+1 ids nearest to the pivot) bounds the distance at which the
k best rows of every query of a cell must lie; a row is sent to a group of queries only if
the triangle inequality lets it be that near. Groups are then solved in blocks of bounded
size, and the blocks' best rows merged.

The score is an inner product. All rows get one more component so that they have equal
length; then the largest inner product is the smallest distance, and the bounds hold.

Defined cases: null vectors and vectors with null or non-finite components take no part;
vectors shorter than the longest count as filled with zeros; a query never meets rows of
its own id, and repeated (id, vector) rows count once; fewer than k candidates give fewer
rows; empty tables give an empty result; equal scores go to the smaller id. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.llm.vectors import best, distances, lifted, matrix, merge_best

#: Pivots are chosen from this many rows (by hash order) at most.
PIVOT_SAMPLE = 512
#: Slack on the bounds for rounding, relative to the length of the rows.
SLACK = 1e-9


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different points, each as far as can be from those before it."""
    chosen, gap = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def bounds(pivots: np.ndarray, cells: list, near: list, k: int, top: float) -> list[tuple]:
    """For each pair of a query cell i and a row cell j: (i, j, lo, hi); only rows whose
    distance from pivot j lies in lo..hi can be among the k best of a query of cell i.
    ``cells``: (cell, radius) of the query cells; ``near``: (cell, distance, id) of the k+1
    ids nearest to each pivot. k+1, as one of them may be the query's own, and an id counts
    once, as all its rows would be."""
    between, out = distances(pivots, pivots), []
    at, d = np.array([c for c, _, _ in near], dtype=int), np.array([x for _, x, _ in near])
    ids = np.array([i for _, _, i in near], dtype="int64")
    slack = SLACK * (1 + np.sqrt(top) + (d.max() if len(d) else 0) + between.max())
    for i, radius in cells:
        order = np.argsort(between[i, at] + d, kind="stable")
        first = np.sort(np.unique(ids[order], return_index=True)[1])
        reach = (between[i, at] + d)[order[first]]
        theta = radius + reach[k] if len(reach) > k else np.inf
        for j in sorted(set(at.tolist())):
            lo = between[i, j] - radius - theta - slack
            out.append((int(i), int(j), float(lo), float(between[i, j] + radius + theta + slack)))
    return out


def solve_block(k: int, dims: int, exact: bool):
    """Top k of a block's queries among a block's rows. ``exact``: sums stay below 2^53, so
    that double arithmetic gives the integer result; else 64-bit integers are used."""

    def solve(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            x, q = matrix(rows["v"], dims), matrix(queries["v"], dims)
            ids = rows["vec_id"].to_numpy()
            if not exact:
                x, q = x.astype("int64"), q.astype("int64")
            for begin in range(0, len(q), 256):
                for qid, s in zip(queries["vec_id"].iloc[begin : begin + 256], q[begin : begin + 256] @ x.T, strict=True):
                    others = np.flatnonzero(ids != qid)
                    found = others[best(s[others], ids[others], k)]
                    out["query_id"] += [qid] * len(found)
                    out["vec_id"] += ids[found].tolist()
                    out["score"] += [int(v) for v in s[found]]
        return pd.DataFrame({c: np.array(v, dtype="int64") for c, v in out.items()})

    return solve


def voronoi_knn(
    rows: DataFrame,
    is_query: Column,
    k: int,
    n_pivots: int = 32,
    queries_per_group: int = 512,
    rows_per_block: int = 8192,
) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query.

    rows: vec_id long, v array<double> of integers. is_query: a condition on ``vec_id``.
    Returns query_id, rank, vec_id, score. Driver: pivots and per-cell summaries only
    (``n_pivots`` squared numbers)."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id is not null").distinct()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(norm2).alias("top")).first()
    schema = "query_id long, vec_id long, score long"
    if not total["n"]:
        return merge_best(spark.createDataFrame([], schema), k)
    n, dims, top = total["n"], total["dims"], float(total["top"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toPandas()
    pivots = farthest_first(lifted(matrix(sample["v"], dims), top), n_pivots)

    def cell(of_queries: bool):
        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = matrix(f["v"], dims)
                x = np.hstack([x, np.zeros((len(x), 1))]) if of_queries else lifted(x, top)
                d = distances(x, pivots)
                yield f.assign(cell=d.argmin(axis=1).astype("int32"), d=d.min(axis=1))

        return assign

    celled = "vec_id long, v array<double>, cell int, d double"
    data = rows.mapInPandas(cell(False), celled)
    queries = rows.where(is_query).mapInPandas(cell(True), celled)

    nearest = Window.partitionBy("cell").orderBy("d", "vec_id")
    ids = data.groupBy("cell", "vec_id").agg(F.min("d").alias("d"))
    near = ids.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).select("cell", "d", "vec_id").collect()
    sizes = queries.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()
    if not sizes:
        return merge_best(spark.createDataFrame([], schema), k)

    # Cells join into groups of about queries_per_group queries; a larger cell is split by hash.
    group, parts, filled = {}, {}, queries_per_group
    for s in sorted(sizes, key=lambda s: (distances(pivots[:1], pivots[s["cell"]][None])[0, 0], s["cell"])):
        if filled + s["n"] > queries_per_group:
            parts[len(parts)], filled = 1, 0
        g = len(parts) - 1
        group[s["cell"]], filled = g, filled + s["n"]
        parts[g] = max(parts[g], -(-s["n"] // queries_per_group))
    pairs = bounds(pivots, [(s["cell"], s["radius"]) for s in sizes], [(r["cell"], r["d"], r["vec_id"]) for r in near], k, top)
    wide: dict[tuple[int, int], tuple[float, float]] = {}
    for i, j, lo, hi in pairs:
        was = wide.get((group[i], j), (np.inf, -np.inf))
        wide[group[i], j] = min(lo, was[0]), max(hi, was[1])
    reach = spark.createDataFrame(
        [(j, g, parts[g], float(lo), float(hi)) for (g, j), (lo, hi) in wide.items()],
        "cell int, grp int, parts int, lo double, hi double",
    )
    of = spark.createDataFrame([(c, g, parts[g]) for c, g in group.items()], "cell int, grp int, parts int")

    salts = -(-n // rows_per_block)
    salt = F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.lit(salts)).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sent = (
        data.join(reach, "cell")
        .where(F.col("d").between(F.col("lo"), F.col("hi")))
        .select("vec_id", "v", "grp", part.alias("part"), salt.alias("salt"))
    )
    asked = queries.join(of, "cell").select(
        "vec_id",
        "v",
        "grp",
        F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    keys = ["grp", "part", "salt"]
    found = (
        sent.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(solve_block(k, dims, exact=top < 2.0**53), schema)
    )
    return merge_best(found, k)
