"""Selection of candidates by influence (R8, R9): one figure a row, from aggregates alone.

A class-weighted logistic model is solved on the training rows by Newton steps. Adding a candidate moves its
coefficients by about ``-g / (1 + c z'H^-1 z)`` times ``H^-1 z`` (H the Hessian of the training loss, z the candidate's
features, g and c the slope and curvature of its own loss). The validation loss follows by its gradient and Hessian at the
optimum. One vector and two small matrices therefore score every candidate row by row; no subset is ever refitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.operators.weight import pos_weight
from rarefold.session import staged

#: Newton steps at most, and the share of the total row weight that the gradient may keep.
STEPS, TOLERANCE = 50, 1e-9
#: Keeps the intercept's equation solvable where no row or only one class is left.
INTERCEPT_RIDGE = 1e-6


def _usable(features: Sequence[str]) -> Column:
    ok = F.lit(True)
    for f in features:
        c = F.col(f"`{f}`").cast("double")
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return ok


def _clean(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Columns x0.. and y of the rows that have every feature and a label."""
    named = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    return rows.where(_usable(features) & F.col(f"`{target}`").isNotNull()).select(*named, F.col(f"`{target}`").cast("double").alias("y"))


def _scales(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([got[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([got[f"s{i}"] or 1.0 for i in range(d)])
    return mean, scale


def _sums(rows: DataFrame, theta: np.ndarray, mean: np.ndarray, scale: np.ndarray, weight: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Loss, gradient, Hessian and total weight over ``rows``: each task passes on one total of (features + 1)^2 figures at most."""
    d = len(mean)
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + d + 1 + len(upper[0]))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.ones((batch.num_rows, d + 1))
            for i in range(d):
                z[:, i + 1] = (batch.column(f"x{i}").to_numpy(zero_copy_only=False) - mean[i]) / scale[i]
            y = batch.column("y").to_numpy(zero_copy_only=False)
            w = np.where(y == 1, weight, 1.0)
            t = z @ theta
            p = 0.5 * (1.0 + np.tanh(0.5 * t))
            total[0] += (w * (np.logaddexp(0.0, t) - y * t)).sum()
            total[1] += w.sum()
            total[2 : 3 + d] += z.T @ (w * (p - y))
            total[3 + d :] += ((z * (w * p * (1 - p))[:, None]).T @ z)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    out = np.zeros(2 + d + 1 + len(upper[0]))
    for r in rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    hessian = np.zeros((d + 1, d + 1))
    hessian[upper] = out[3 + d :]
    hessian = hessian + np.triu(hessian, 1).T
    return out[0], out[2 : 3 + d], hessian, out[1]


@dataclass
class InfluenceRule:
    """R8 result: what a row is expected to take off the mean validation loss when it joins the training rows."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    #: intercept and coefficients of the standardised features, and H^-1 times the validation gradient
    theta: list[float]
    direction: list[float]
    #: weight of a row of the rare class
    weight: float
    #: H^-1, and H^-1 V H^-1 with V the Hessian of the mean validation loss
    inverse: np.ndarray
    bend: np.ndarray

    def _standardised(self) -> Column:
        return F.array(*[(F.col(f"`{f}`").cast("double") - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.mean, self.scale, strict=True)])

    def _logit(self) -> Column:
        terms = F.zip_with(self._standardised(), F.array(*[F.lit(c) for c in self.theta[1:]]), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(self.theta[0]), lambda a, b: a + b)

    def score(self, pool: DataFrame, label: int = 1, out: str = "predicted_gain") -> DataFrame:
        """``pool`` plus the gain of each row under ``label``; null where a feature is null or not finite."""
        theta, direction, inverse, bend = np.array(self.theta), np.array(self.direction), self.inverse, self.bend
        w = self.weight if label == 1 else 1.0

        @F.pandas_udf(T.DoubleType())
        def gains(x: pd.Series) -> pd.Series:
            z = np.column_stack([np.ones(len(x)), np.stack(x.to_numpy())]) if len(x) else np.ones((0, len(theta)))
            p = 0.5 * (1.0 + np.tanh(0.5 * (z @ theta)))
            own = w * (p - label) / (1.0 + w * p * (1 - p) * ((z @ inverse) * z).sum(axis=1))
            return pd.Series(own * (z @ direction) - 0.5 * own * own * ((z @ bend) * z).sum(axis=1))

        usable = _usable(self.features)
        nothing = F.array(*[F.lit(0.0)] * len(self.features))
        return pool.withColumn(out, F.when(usable, gains(F.when(usable, self._standardised()).otherwise(nothing))))

    def select(self, pool: DataFrame, out: str = "keep", label: int = 1) -> DataFrame:
        """Accept or reject every row of ``pool``; keep if the predicted gain is above 0. A row without a gain goes."""
        return self.score(pool, label).withColumn(out, F.coalesce(F.col("predicted_gain") > 0, F.lit(False)))


def fit_influence_rule(train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, reg: float = 1.0, scale_pos_weight="auto") -> InfluenceRule:
    """The rule from two tables with a 0/1 ``target``.

    ``reg`` is the penalty on squared standardised coefficients beside the summed loss. Rows of the rare class weigh
    negatives / positives of ``train`` (or the number given) in both losses. Rows with a null or non-finite feature, or
    without a label, are left out of the fit. A constant feature has coefficient 0. Without validation rows every gain
    is 0 and nothing is kept. What reaches the driver are sums: (features + 1)^2 figures, whatever the number of rows.
    """
    features = list(features)
    d = len(features)
    rows = staged(_clean(train, features, target), "influence-train")
    mean, scale = _scales(rows, d)
    weight = pos_weight(rows, "y", scale_pos_weight)
    ridge = np.diag([INTERCEPT_RIDGE] + [float(reg)] * d)

    def at(theta: np.ndarray):
        loss, grad, hessian, total = _sums(rows, theta, mean, scale, weight)
        return loss + 0.5 * theta @ ridge @ theta, grad + ridge @ theta, hessian + ridge, total

    theta = np.zeros(d + 1)
    loss, grad, hessian, total = at(theta)
    for _ in range(STEPS):
        if np.abs(grad).max() <= TOLERANCE * max(1.0, total):
            break
        step = np.linalg.solve(hessian, grad)
        new = at(theta - step)
        while new[0] > loss + 1e-12 * abs(loss) and np.abs(step).max() > 1e-12:  # damped where a full step overshoots
            step = step / 2
            new = at(theta - step)
        theta = theta - step
        loss, grad, hessian, total = new
    _, slope, curve, seen = _sums(_clean(validation, features, target), theta, mean, scale, weight)
    seen = seen or 1.0  # no validation rows: slope and curve are 0
    inverse = np.linalg.inv(hessian)
    as_list = lambda v: [float(x) for x in v]
    return InfluenceRule(features, as_list(mean), as_list(scale), as_list(theta), as_list(inverse @ slope / seen), float(weight), inverse, inverse @ curve @ inverse / seen)


def stationarity(rule: InfluenceRule, train: DataFrame, target: str, reg: float = 1.0) -> DataFrame:
    """(feature, gradient): the penalised loss's gradient at the rule's coefficients, as a share of the total weight.

    One aggregate of built-in functions, apart from the code that fits; all gradients are 0 at the optimum.
    """
    y = F.col(f"`{target}`").cast("double")
    w = F.when(y == 1, F.lit(rule.weight)).otherwise(F.lit(1.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-rule._logit()))
    rows = train.where(_usable(rule.features) & y.isNotNull()).withColumn("__r", w * (p - y)).withColumn("__w", w)
    sums = [F.sum("__r") + F.lit(INTERCEPT_RIDGE * rule.theta[0])]
    for f, m, s, t in zip(rule.features, rule.mean, rule.scale, rule.theta[1:], strict=True):
        sums.append(F.sum(F.col("__r") * (F.col(f"`{f}`").cast("double") - F.lit(m)) / F.lit(s)) + F.lit(reg * t))
    names = ["(intercept)", *rule.features]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), (c / F.sum("__w")).alias("gradient")) for n, c in zip(names, sums, strict=True)])
    return rows.agg(pairs.alias("pairs")).select(F.explode("pairs").alias("pair")).select("pair.*")
