"""Both vector searches against brute force, and their edge cases."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import queries as Q
from sensorlake.llm.srs_ann import chi_square_quantile, kd_leaves, srs_neighbours
from sensorlake.llm.vectors import usable
from sensorlake.llm.voronoi_knn import voronoi_knn

from tests.conftest import SMOKE_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int"


def table(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return folder


def brute(rows, every, k, ints):
    good = {}
    for i, e, *_ in rows:
        if i is not None and e is not None and None not in e and np.isfinite(e).all():
            x = np.array(e, dtype="f4").astype(float)
            good[i] = np.floor(256 * x) if ints else x
    if not ints:
        good = {i: x for i, x in good.items() if x.any()}
    out = []
    for q, x in good.items():
        if q % every == 0:
            s = sorted((-float(sum(a * b for a, b in zip(x, y))), i) for i, y in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


def rows_of(n, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).astype("f4").tolist(), 0, "x", 1) for i in range(n)]
    rows[7] = (7, rows[50][1], None, None, None)  # ties
    rows[8] = (8, rows[50][1], None, None, None)
    rows[9] = (9, None, 0, "x", 1)
    rows[10] = (10, [0.1, None, 0.2, 0.3, 0.4, 0.5], 0, "x", 1)
    rows[11] = (11, [0.1, float("nan"), 0.2, 0.3, 0.4, 0.5], 0, "x", 1)
    rows[12] = (12, [float("inf")] + [0.0] * 5, 0, "x", 1)
    rows[13] = (13, [0.0] * 6, 0, "x", 1)
    return [*rows, rows[50], rows[3]]  # repeated rows


def test_knn_is_exact_with_nulls_ties_and_repeats(spark, scratch):
    rows = rows_of(230)
    got = Q.op1_voronoi_knn(spark, table(spark, scratch, rows)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in got) == brute(rows, 50, 5, True)


@pytest.mark.parametrize("pivots,per_group,per_block", [(1, 1, 7), (5, 2, 50), (64, 3, 1000)])
def test_knn_does_not_depend_on_its_parameters(spark, pivots, per_group, per_block):
    rows = rows_of(120)
    df = spark.createDataFrame(rows, SCHEMA).where(usable("embedding"))
    ints = F.transform("embedding", lambda x: F.floor(256.0 * x.cast("double")).cast("double"))
    got = voronoi_knn(df.select("vec_id", ints.alias("v")), F.col("vec_id") % 50 == 0, 5, pivots, per_group, per_block)
    assert sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in got.collect()) == brute(rows, 50, 5, True)


@pytest.mark.parametrize("pivots", [1, 8])
def test_knn_where_one_id_has_several_vectors(spark, pivots):
    rng = np.random.default_rng(4)
    turn = rng.uniform(1.5, 4.5, 200)  # on the far side of a circle
    rows = [(i, [float(round(1000 * np.cos(t))), float(round(1000 * np.sin(t)))]) for i, t in enumerate(turn) if i % 50]
    rows += [(50, [1000.0, float(j)]) for j in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = voronoi_knn(df, F.col("vec_id") % 50 == 0, 5, pivots)
    con = duckdb.connect()
    con.execute("CREATE TABLE s (id BIGINT, v DOUBLE[])")
    con.executemany("INSERT INTO s VALUES (?, ?)", rows)
    want = con.execute("""
        SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
              FROM (SELECT DISTINCT * FROM s) q JOIN (SELECT DISTINCT * FROM s) c ON q.id <> c.id WHERE q.id % 50 = 0)) WHERE rank <= 5""").fetchall()
    assert sorted((r.query_id, r["rank"], r.score) for r in got.collect()) == sorted((q, r, x) for q, r, _, x in want)


def test_knn_matches_sql_on_the_given_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMOKE_DIR}/embeddings.parquet')")
    want = con.execute(Q.ORACLE["op1_voronoi_knn"]).fetchall()
    got = Q.op1_voronoi_knn(spark, SMOKE_DIR).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["op1_voronoi_knn", "op5_srs_neighbours"])
@pytest.mark.parametrize("rows", [[], [(0, None, 1, "a", 1)], [(0, [1.0, 2.0], 1, "a", 1)], [(0, [], 1, "a", 1), (1, [], 1, "a", 1)]])
def test_small_tables(spark, scratch, name, rows):
    got = Q.QUERIES[name](spark, table(spark, scratch, rows)).collect()
    # Two empty vectors: their inner product is 0 (the integer search), or they are zero (the other).
    assert len(got) == (1 if len(rows) == 2 and name.startswith("op1") else 0)


def test_fewer_candidates_than_k_and_large_numbers(spark, scratch):
    rows = [(0, [3e30, 1.0], 0, "", 0), (20, [1e30, 2.0], 0, "", 0), (21, [-1.0, 2.0], 0, "", 0)]
    got = Q.op5_srs_neighbours(spark, table(spark, scratch, rows)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]


def test_srs_recall_order_and_scores(spark):
    df = spark.read.parquet(f"{SMOKE_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in Q.op5_srs_neighbours(spark, SMOKE_DIR).collect())
    want = brute(rows, 20, 20, False)
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)
    x = {i: np.array(e, dtype=float) for i, e in rows}
    for q, _, i, s in got:
        assert s == pytest.approx(float(x[q] @ x[i]), abs=1e-12)
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or (-a[3], a[2]) < (-b[3], b[2])


def test_srs_recall_where_the_test_stops_early(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, v array<double>")
    got = srs_neighbours(df, F.col("vec_id") % 100 == 0, 20, rows_per_block=1000, leaf=32).collect()
    hits = 0
    for q in range(0, 4000, 100):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 40 * 20


def test_equal_vectors_by_the_thousand_give_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(1500)], "vec_id long, v array<double>")
    got = srs_neighbours(df, F.col("vec_id") == 1000, 20, rows_per_block=400, leaf=32)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == list(range(20))


def test_chi_square_and_kd_tree():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    x = np.random.default_rng(0).normal(size=(500, 3))
    leaves = kd_leaves(x, 20)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(500)) and max(map(len, leaves)) <= 20
