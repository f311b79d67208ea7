"""Selection of synthetic candidates (R1-R9), re-aimed from a sequential RL agent.

Episodes are random subsets of the pool; each is scored by the gain of a
training metric when its kept rows join the base training rows. The accept
rule is a ridge regression of episode reward on the kept rows' mean feature
vector; applying it is row-parallel. The sequential running ratio of the
reference (each decision feeding the next) is kept as a state computation for
a *given* keep column (R2) but is not used to decide, because it cannot be split.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefold.functions.rng import uniform
from rarefold.operators.metrics import ranking_metrics, threshold_metrics

log = logging.getLogger(__name__)

EPISODE_SIZE = 128  # reference episode batch size
EPISODES_PER_UPDATE = 8


def draw_episodes(pool: DataFrame, id_col: str, n_episodes: int = EPISODES_PER_UPDATE, size: int = EPISODE_SIZE, seed: int = 42) -> DataFrame:
    """Per episode, a random subset of ``min(size, pool)`` rows without replacement.

    (episode, id, position): position is the 0-based order inside the episode.
    The per-episode top-``size`` is a window group limit, so Spark keeps at most
    ``size`` rows per episode in each task before the shuffle.
    """
    eps = F.array(*[F.lit(e) for e in range(n_episodes)])
    pairs = pool.select(F.col(id_col), F.explode(eps).alias("episode"))
    pairs = pairs.withColumn("__u", uniform(seed, "episode", "episode", id_col))
    w = Window.partitionBy("episode").orderBy("__u", id_col)
    r = pairs.withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < size)
    return r.select("episode", id_col, F.col("position").cast("int").alias("position"))


def random_keep(episodes: DataFrame, id_col: str, seed: int = 42, p: float = 0.5, out: str = "keep") -> DataFrame:
    """Random-inclusion decisions used to explore (keep with probability p)."""
    return episodes.withColumn(out, uniform(seed, "keep", "episode", id_col) < F.lit(p))


def running_state(episodes: DataFrame, keep: str = "keep") -> DataFrame:
    """R2: progress = position / n, ratio = share kept among earlier rows (0 first)."""
    w_all = Window.partitionBy("episode")
    w_prev = Window.partitionBy("episode").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return episodes.withColumn("progress", F.col("position") / F.count(F.lit(1)).over(w_all)).withColumn(
        "ratio", F.coalesce(F.avg(F.col(keep).cast("double")).over(w_prev), F.lit(0.0))
    )


def observation(features: DataFrame, state: DataFrame, id_col: str, obs_col: str = "obs") -> DataFrame:
    """Feature vector ++ [progress, ratio] (length d + 2)."""
    j = state.join(features.select(id_col, obs_col), id_col)
    return j.withColumn("observation", F.concat(F.col(obs_col), F.array(F.col("progress").cast("float"), F.col("ratio").cast("float"))))


def reward_metric(scored: DataFrame, target: str, score: str, name: str = "average_precision") -> float:
    """The figure that a reward compares: ``average_precision`` of the scores, or ``f1`` of the labels at 0.5 (0 if undefined).

    Any other name is an error.
    """
    if name == "average_precision":
        return ranking_metrics(scored, target, score, fpr_targets=()).first()["auc_pr"]
    if name == "f1":
        return threshold_metrics(scored, target, score).first()["f1"] or 0.0
    raise ValueError(f"unknown reward metric: {name}")


def reward_formula(raw: F.Column, baseline: F.Column, n_kept: F.Column, normalize: bool = True) -> tuple[F.Column, F.Column]:
    """R6 rule: reward = raw - baseline (divided by max(|baseline|, 1e-6)); nothing kept -> (0, baseline)."""
    r = raw - baseline
    if normalize:
        r = r / F.greatest(F.abs(baseline), F.lit(1e-6))
    empty = n_kept == 0
    return F.when(empty, F.lit(0.0)).otherwise(r), F.when(empty, baseline).otherwise(raw)


def episode_summary(decided: DataFrame, raw_scores: DataFrame, baseline: float, keep: str = "keep", normalize: bool = True) -> DataFrame:
    """(episode, n_selected, n_candidates, raw_score, baseline_score, reward)."""
    counts = decided.groupBy("episode").agg(
        F.count_if(F.col(keep)).cast("long").alias("n_selected"), F.count(F.lit(1)).cast("long").alias("n_candidates")
    )
    j = counts.join(raw_scores, "episode", "left")
    reward, raw = reward_formula(F.col("raw_score"), F.lit(float(baseline)), F.col("n_selected"), normalize)
    return j.select("episode", "n_selected", "n_candidates", raw.alias("raw_score"), F.lit(float(baseline)).alias("baseline_score"), reward.alias("reward"))


@dataclass
class AcceptRule:
    """R8 result: predicted reward gain of a row = intercept + coef . features."""

    features: list[str]
    coefficients: list[float]
    intercept: float

    def score(self, pool: DataFrame, out: str = "predicted_gain") -> DataFrame:
        expr = F.lit(float(self.intercept))
        for f, c in zip(self.features, self.coefficients):
            expr = expr + F.lit(float(c)) * F.col(f"`{f}`").cast("double")
        return pool.withColumn(out, expr)

    def select(self, pool: DataFrame, out: str = "keep") -> DataFrame:
        """Deterministic accept/reject of every pool row (row-parallel); keep if predicted gain > 0."""
        return self.score(pool).withColumn(out, F.col("predicted_gain") > 0)


def fit_accept_rule(
    pool: DataFrame,
    id_col: str,
    features: Sequence[str],
    metric_of: Callable[[DataFrame | None], float],
    n_episodes: int = EPISODES_PER_UPDATE,
    size: int = EPISODE_SIZE,
    seed: int = 42,
    normalize: bool = True,
    reg: float = 1.0,
    threads: int = 4,
):
    """R5 + R6 + R8: baseline once, random-inclusion episodes, one reward per
    episode (each a distributed fit, run from a small thread pool), then a
    ridge regression of reward on the mean feature vector of the kept rows.

    ``metric_of(kept_rows_or_None)`` returns R4 of base (+ kept rows).
    Returns (rule, summary DataFrame).
    """
    spark = pool.sparkSession
    baseline = metric_of(None)
    eps = random_keep(draw_episodes(pool, id_col, n_episodes, size, seed), id_col, seed)
    decided = eps.join(pool, id_col).cache()
    n_kept = {r["episode"]: r["n"] for r in decided.groupBy("episode").agg(F.count_if("keep").alias("n")).collect()}

    def run(e):
        if not n_kept.get(e):
            return e, baseline
        kept = decided.where((F.col("episode") == e) & F.col("keep")).drop("episode", "position", "keep")
        return e, metric_of(kept)

    with ThreadPoolExecutor(max_workers=threads) as ex:
        raws = list(ex.map(run, range(n_episodes)))
    raw_df = spark.createDataFrame([(int(e), float(s)) for e, s in raws], "episode int, raw_score double")
    summary = episode_summary(decided, raw_df, baseline, normalize=normalize)
    means = decided.where("keep").groupBy("episode").agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f) for f in features])
    train = means.join(summary.select("episode", "reward"), "episode")
    vec = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(train)
    lr = LinearRegression(featuresCol="__x", labelCol="reward", regParam=reg, elasticNetParam=0.0, standardization=True).fit(vec)
    rule = AcceptRule(list(features), [float(x) for x in lr.coefficients], float(lr.intercept))
    decided.unpersist()
    return rule, summary
