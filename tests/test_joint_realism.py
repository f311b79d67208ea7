"""Joint category draws, cross-fitted realism and the choice of the reward metric."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rarefold.operators import metrics as M
from rarefold.operators import select as R
from rarefold.operators import synth as G


def _chain(spark, n=1500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        a = rng.choice(["u", "v", "w", None])
        b = {"u": "1", "v": "2", "w": "3", None: "4"}[a] if rng.random() < 0.9 else rng.choice("1234")
        c = None if b == "1" else "c" + b
        rows.append((i, a, rng.choice("xyz"), b, c, rng.gauss(0, 1), i % 2))
    return spark.createDataFrame(rows, "id long, a string, free string, b string, c string, x double, y int"), rows


def test_tree_and_information(spark):
    df, rows = _chain(spark)
    cols = ["a", "free", "b", "c"]
    got = {(r["first_feature"], r["second_feature"]): r for r in G.information_tree(G.pair_counts(df, cols), cols).collect()}
    at = {"a": 1, "free": 2, "b": 3, "c": 4}
    for (p, q), r in got.items():
        both, one, two = Counter((x[at[p]], x[at[q]]) for x in rows), Counter(x[at[p]] for x in rows), Counter(x[at[q]] for x in rows)
        want = sum(k * math.log(k * len(rows) / (one[u] * two[v])) for (u, v), k in both.items()) / len(rows)
        assert r["information"] == pytest.approx(want, abs=1e-9)
    chosen = {k for k, r in got.items() if r["in_tree"]}
    assert {("b", "c"), ("a", "b")} <= chosen and len(chosen) == 3


def test_sample_keeps_pairs(spark):
    df, rows = _chain(spark)
    out = G.joint_sample(df, ["a", "free", "b", "c"], 6000, 1).collect()
    assert len(out) == 6000
    assert all(r["c"] == (None if r["b"] == "1" else "c" + r["b"]) for r in out)
    want, got = Counter((x[1], x[3]) for x in rows), Counter((r["a"], r["b"]) for r in out)
    for pair, k in want.items():
        p = k / len(rows)
        assert abs(got[pair] / 6000 - p) < 5 * math.sqrt(p / 6000) + 1e-3
    one = G.joint_sample(df.where("id < 0"), ["a", "b"], 10, 1)
    assert one.count() == 0  # nothing to draw from


def test_mixture_draws_joint_categories(spark):
    df, _ = _chain(spark, 400)
    s = G.fit_mixture(df, "y", ["x"], ["a", "b", "c"], k=2, seed=4).sample(spark, 500, "y", 1, 4).collect()
    assert len(s) == 500
    assert all(r["c"] == (None if r["b"] == "1" else "c" + r["b"]) for r in s)


def _auc(scored):
    y = scored.withColumn("r", (F.col("origin") == "real").cast("int"))
    return M.ranking_metrics(y, "r", "realism", fpr_targets=()).first()["auc_roc"]


def test_realism_of_real_rows_and_of_other_categories(spark):
    df, _ = _chain(spark)
    cols = (["x"], ["a", "b"], "y")
    one, two = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    assert abs(_auc(G.realism_score(one, two, *cols)) - 0.5) < 0.06
    other = two.withColumn("b", F.lit("9"))
    assert _auc(G.realism_score(one, other, *cols)) > 0.99
    # each category is as frequent as before, but belongs to the other class
    real = df.withColumn("b", F.when(F.col("y") == 1, "p").otherwise("q"))
    fake = df.withColumn("b", F.when(F.col("y") == 1, "q").otherwise("p"))
    assert _auc(G.realism_score(real, fake, ["x"], ["b"], "y")) > 0.99


def test_reward_metric_choice(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "y int, s double")
    assert R.reward_metric(df, "y", "s", "f1") == pytest.approx(0.5)
    assert R.reward_metric(df, "y", "s") == pytest.approx((1 + 2 / 3) / 2)
    assert R.reward_metric(df.withColumn("s", F.lit(0.1)), "y", "s", "f1") == 0.0
    with pytest.raises(ValueError, match="auc"):
        R.reward_metric(df, "y", "s", "auc")
