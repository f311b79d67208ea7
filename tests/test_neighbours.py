"""Block-wise nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators import oversample as O


def brute(rows, k, penalty=0.0):
    """rows: (id, group, coordinates, category) -> {(group, id): [(neighbour, distance)]}"""
    out = {}
    for i, g, x, c in rows:
        near = []
        for j, h, y, d in rows:
            if g is not None and g == h and i != j:
                total = 0.0
                for p, q in zip(x, y, strict=True):
                    total += (p - q) * (p - q)
                near.append((float(np.sqrt(total + (penalty**2 if c != d else 0.0))), j))
        out[g, i] = [(j, d) for d, j in sorted(near)[:k]]
    return {key: v for key, v in out.items() if v}


def answer(nn, group="g"):
    out = {}
    for r in nn.orderBy("rank").collect():
        out.setdefault((r[group], r["id"]), []).append((r["neighbor_id"], r["distance"]))
        assert r["rank"] == len(out[r[group], r["id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, g, [float(v) for v in x], c, *map(float, x[:2])) for i, g, x, c in rows], "id long, g string, v array<double>, c string, x double, y double")


def test_many_dimensions_blocks_and_pivots(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 12)) * 20
    rows = [(i, "ab"[i % 2], tuple(centers[i % 6] + rng.normal(size=12)), "z") for i in range(260)] + [(999, None, (0.0,) * 12, "z")]
    df = frame(spark, rows)
    want = brute(rows, 4)
    for block, pivots in ((16, 8), (50, 1), (None, 64)):
        assert answer(O.knn_within(df, "id", vector_col="v", k=4, group_cols=["g"], block_rows=block, pivots=pivots)) == want


def test_categories_and_ties_on_a_grid(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "a", tuple(map(float, rng.integers(0, 6, 2))), "pqr"[int(rng.integers(3))]) for i in range(200)]
    df = frame(spark, rows)
    assert answer(O.knn_within(df, "id", ["x", "y"], ["c"], k=5, group_cols=["g"], penalty=1.5, block_rows=12, pivots=5)) == brute(rows, 5, 1.5)
    assert answer(O.knn_within(df, "id", ["x", "y"], ["c"], k=3, group_cols=["g"], block_rows=12, pivots=5)) == brute(rows, 3)


def test_half_of_the_rows_are_one_point(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a", (1.0, -0.0) if i % 2 else tuple(rng.normal(size=2)), "z") for i in range(300)] + [(300 + i, "a", (1.0, 0.0), "z") for i in range(9)]
    assert answer(O.knn_within(frame(spark, rows), "id", ["x", "y"], k=4, group_cols=["g"], block_rows=20, pivots=6)) == brute(rows, 4)


def test_fewer_rows_than_neighbours_and_none(spark):
    rows = [(1, "a", (0.0, 0.0), "z"), (2, "a", (3.0, 4.0), "z"), (3, "b", (1.0, 1.0), "z")]
    df = frame(spark, rows)
    assert answer(O.knn_within(df, "id", vector_col="v", k=5, group_cols=["g"])) == {("a", 1): [(2, 5.0)], ("a", 2): [(1, 5.0)]}
    assert O.knn_within(df.where("id < 0"), "id", vector_col="v", k=5).count() == 0
    with pytest.raises(ValueError, match="one length"):
        O.knn_within(df.withColumn("v", F.when(F.col("id") == 1, F.array(F.lit(1.0))).otherwise(F.col("v"))), "id", vector_col="v")


def test_far_blocks_are_not_compared(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(size=(4000, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    seen = []
    plain = O.block_pairs

    def counted(*args):
        out = plain(*args)
        seen.append((out.count(), args[0].count()))
        return out

    O.block_pairs = counted
    try:
        got = O.knn_within(df, "id", ["x", "y"], k=3, block_rows=50, pivots=32).collect()
    finally:
        O.block_pairs = plain
    assert len(got) == 12_000
    pairs, blocks = seen[0]
    assert pairs < 0.2 * blocks * blocks
