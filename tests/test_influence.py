"""The accept rule by influence against a plain solver and against refits with one candidate more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators import influence as I

FEATS = ["a", "b"]


def _solve(x, y, w, reg=1.0):
    z = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([I.INTERCEPT_RIDGE] + [reg] * x.shape[1])
    t = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ t))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge
        t = t - np.linalg.solve(h, z.T @ (w * (p - y)) + ridge @ t)
    return t


def _loss(x, y, w, t):
    s = np.column_stack([np.ones(len(x)), x]) @ t
    return (w * (np.logaddexp(0, s) - y * s)).sum() / w.sum()


def _data(seed, n):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 2)) * [3.0, 0.5] + [10.0, -1.0]
    y = (g.random(n) < 1 / (1 + np.exp(3 - 0.8 * (x[:, 0] - 10) + 2 * (x[:, 1] + 1)))).astype(int)
    return x, y


def _frame(spark, x, y, parts=4):
    rows = [(i, float(p[0]), float(p[1]), int(t)) for i, (p, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(parts)


@pytest.fixture(scope="module")
def fitted(spark):
    (x, y), (vx, vy) = _data(0, 600), _data(1, 400)
    return x, y, vx, vy, I.fit_influence_rule(_frame(spark, x, y), _frame(spark, vx, vy), FEATS, "y")


def test_coefficients_equal_a_plain_solver(fitted):
    x, y, _, _, rule = fitted
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    z = (x - x.mean(0)) / x.std(0)
    assert rule.theta == pytest.approx(_solve(z, y, w), abs=1e-6)


def test_gains_agree_with_refits(spark, fitted):
    x, y, vx, vy, rule = fitted
    m, s = x.mean(0), x.std(0)
    weight = (y == 0).sum() / (y == 1).sum()
    w, vw = np.where(y == 1, weight, 1.0), np.where(vy == 1, weight, 1.0)
    g = np.random.default_rng(5)
    cand = g.normal(size=(60, 2)) * [4.0, 0.8] + [10.0, -1.0]
    z, vz, cz = (x - m) / s, (vx - m) / s, (cand - m) / s
    before = _loss(vz, vy, vw, _solve(z, y, w))
    true = [before - _loss(vz, vy, vw, _solve(np.vstack([z, c]), np.append(y, 1), np.append(w, weight))) for c in cz]
    got = {r["id"]: r for r in rule.select(_frame(spark, cand, np.ones(60))).collect()}
    pred = np.array([got[i]["predicted_gain"] for i in range(60)])
    true = np.array(true)
    clear = np.abs(true) > 0.1 * np.abs(true).max()
    assert clear.sum() >= 20
    assert (np.sign(pred[clear]) == np.sign(true[clear])).all()
    assert np.corrcoef(pred, true)[0, 1] > 0.98
    assert all(got[i]["keep"] == (pred[i] > 0) for i in range(60))


def test_stationarity_notices_a_wrong_fit(spark, fitted):
    x, y, _, _, rule = fitted
    df = _frame(spark, x, y)
    assert all(abs(r["gradient"]) < 1e-8 for r in I.stationarity(rule, df, "y").collect())
    off = I.InfluenceRule(rule.features, rule.mean, rule.scale, [t + 0.01 for t in rule.theta], rule.direction, rule.weight, rule.inverse, rule.bend)
    assert any(abs(r["gradient"]) > 1e-4 for r in I.stationarity(off, df, "y").collect())


def test_partitions_do_not_matter(spark, fitted):
    x, y, vx, vy, rule = fitted
    one = I.fit_influence_rule(_frame(spark, x, y, 1), _frame(spark, vx, vy, 9), FEATS, "y")
    assert one.theta == pytest.approx(rule.theta, abs=1e-9)
    assert one.direction == pytest.approx(rule.direction, abs=1e-9)


def test_awkward_rows(spark, fitted):
    x, y, vx, vy, rule = fitted
    bad = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0)], "id long, a double, b double")
    assert all(r["predicted_gain"] is None and r["keep"] is False for r in rule.select(bad).collect())
    dirty = _frame(spark, x, y).unionByName(bad.withColumn("y", F.lit(1))).unionByName(_frame(spark, x[:3], y[:3]).withColumn("y", F.lit(None).cast("int")))
    assert I.fit_influence_rule(dirty, _frame(spark, vx, vy), FEATS, "y").theta == pytest.approx(rule.theta, abs=1e-9)
    no_validation = I.fit_influence_rule(_frame(spark, x, y), _frame(spark, vx, vy).where("false"), FEATS, "y")
    assert not no_validation.select(_frame(spark, x, y)).where("keep").count()
    constant = I.fit_influence_rule(_frame(spark, x, y).withColumn("b", F.lit(2.0)), _frame(spark, vx, vy).withColumn("b", F.lit(2.0)), FEATS, "y")
    assert constant.theta[2] == 0 and np.isfinite(constant.direction).all()
    empty = I.fit_influence_rule(_frame(spark, x, y).where("false"), _frame(spark, vx, vy), FEATS, "y")
    assert np.isfinite(empty.theta).all()
