import pandas as pd
import pytest
from pyspark.sql import functions as F

from rarefold.functions.prefix import global_row_number, running_totals
from rarefold.functions.quantile import exact_quantiles
from rarefold.operators import split as S
from rarefold.operators.join import left_join


def test_row_number_with_hot_key(spark):
    # one time value holds a third of the rows: isolated bucket, split on the id
    rows = [(i, 5 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t long")
    got = {r["id"]: r["rn"] for r in global_row_number(df, "t", "id", n_buckets=16).collect()}
    exp = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(exp)}


def test_running_totals_peers_without_tiebreak(spark):
    rows = [(i, 7.0 if i < 50 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s double")
    got = {r["id"]: r["c"] for r in running_totals(df, "s", {"c": F.lit(1)}, descending=True, n_buckets=8).collect()}
    p = pd.DataFrame(rows, columns=["id", "s"])
    p["c"] = p["s"].map(lambda v: (p["s"] >= v).sum())
    assert got == dict(zip(p["id"], p["c"]))


@pytest.mark.parametrize("n", [0, 1, 7])
def test_time_split_all_equal_times(spark, n):
    df = spark.createDataFrame([(i, 1, i % 2) for i in range(n)], "id long, t long, y int")
    lab = S.assign_time_split(df, "t", 0.7, 0.15, tiebreak="id")
    got = dict((r["id"], r["split"]) for r in lab.collect())
    tr, va = int(n * 0.7), int(n * (0.7 + 0.15))
    exp = {i: ("train" if i < tr else "val" if i < va else "test") for i in range(n)}
    assert got == exp


def test_stratified_split_proportions_and_determinism(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(100)], "id long, y int")
    a = S.assign_random_split(df, "y", "id", seed=7)
    b = S.assign_random_split(df.repartition(5), "y", "id", seed=7)
    assert sorted(a.collect()) == sorted(b.collect())
    c = {(r["split"], r["y"]): r["n"] for r in a.groupBy("split", "y").agg(F.count("*").alias("n")).collect()}
    assert c[("train", 0)] == 67 and c[("train", 1)] == 2
    with pytest.raises(ValueError):
        S.assign_random_split(df, "y", "id", 0.5, 0.2, 0.2)
    one = spark.createDataFrame([(i, 0) for i in range(10)], "id long, y int")
    assert S.class_counts(one, "y").first().asDict() == {"negative": 10, "positive": 0}


def test_left_join_semantics(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0), (4, 4.0)], "id long, a double")
    right = spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (None, "z", "r"), (2, "w", "s")], "id long, a string, b string")
    j = left_join(left, right, "id")
    assert j.columns == ["id", "a_x", "a_y", "b"]
    out = j.collect()
    got = sorted((r["id"] if r["id"] is not None else -1, r["a_x"], r["a_y"] or "") for r in out)
    assert got == sorted([(1, 1.0, "x"), (1, 1.0, "y"), (2, 2.0, "w"), (-1, 3.0, "z"), (4, 4.0, "")])


def test_exact_median_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.normal(size=1001)
    b = np.concatenate([np.full(600, 2.0), rng.normal(size=401)])  # a hot value
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], 0.5, n_buckets=16)
    assert got["a"] == pytest.approx(np.median(a))
    assert got["b"] == pytest.approx(np.median(b))


@pytest.mark.parametrize("ranges", [2, 8, 200])
@pytest.mark.parametrize("descending", [False, True])
def test_nulls_and_hot_values_at_any_width(spark, ranges, descending):
    rows = [(i, None if i % 5 == 0 else 3.0 if i % 3 == 0 else float("nan") if i % 7 == 0 else float(i % 40)) for i in range(210)]
    df = spark.createDataFrame(rows, "id long, s double")
    clean = {i: None if s is None or s != s else s for i, s in rows}
    rank = lambda s: (s is not None, s or 0.0)  # noqa: E731  nulls first ascending, last descending
    first = (lambda a, b: rank(a) >= rank(b)) if descending else (lambda a, b: rank(a) <= rank(b))
    got = {r.id: r.c for r in running_totals(df, "s", {"c": F.lit(1)}, descending=descending, n_buckets=ranges).collect()}
    assert got == {i: sum(first(t, s) for t in clean.values()) for i, s in clean.items()}
    numbered = {r.id: r.rn for r in global_row_number(df, "s", "id", descending=descending, n_buckets=ranges).collect()}
    order = sorted(clean, key=lambda i: i)
    order.sort(key=lambda i: rank(clean[i]), reverse=descending)
    assert numbered == {i: k + 1 for k, i in enumerate(order)}


def test_order_and_ties_of_any_type(spark):
    big = 2**53
    rows = [(f"k{i % 50:03d}-{i}", big + i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, t long")
    got = {r.id: r.rn for r in global_row_number(df, "t", "id", n_buckets=8).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    peers = {r.t: r.c for r in running_totals(df, "t", {"c": F.lit(1)}).select("t", "c").distinct().collect()}
    assert peers == {big: 200, big + 1: 400, big + 2: 600}
    lab = S.assign_time_split(df, "t", 0.5, 0.25, tiebreak="id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in lab} == {"train": 300, "val": 150, "test": 150}


def test_groups_with_a_null_name(spark):
    df = spark.createDataFrame([(g, i) for g in (None, "a") for i in range(30)], "g string, x long")
    got = {(r.g, r.x): r.rn for r in global_row_number(df, "x", partition_by=["g"], n_buckets=5).collect()}
    assert got == {(g, i): i + 1 for g in (None, "a") for i in range(30)}
