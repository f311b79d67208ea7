"""One task's trees are those of a job for each level, and no tree is grown beyond the stop."""

import pytest
from pyspark.sql import functions as F

from rarefold.operators import boost
from rarefold.operators.metrics import ranking_metrics


@pytest.fixture(scope="module")
def parts(spark):
    u = lambda salt: (F.hash(F.col("id"), F.lit(salt)) % 1000) / 1000.0
    rows = spark.range(1500).select("id", u(1).alias("a"), F.abs(F.hash(F.col("id"), F.lit(2)) % 9).cast("int").alias("c"), F.round(u(3), 1).alias("d"))
    rows = rows.select("id", "a", "c", "d", ((F.col("a") + F.col("c") / 9 + u(4)) > 1.0).cast("int").alias("y"))
    return rows.where("id % 3 > 0").coalesce(1), rows.where("id % 3 = 0").coalesce(1)


def test_one_task_grows_the_trees_of_the_jobs(spark, parts, monkeypatch):
    train, val = parts
    p = boost.BoostParams(max_iter=40, max_depth=3, step_size=0.3, early_stopping_rounds=5, block=3)
    monkeypatch.setattr(boost, "ALONE_FRESH", 4)
    monkeypatch.setattr(boost, "ROWS", 300)  # four partitions
    fit = lambda: boost.train_boosted(train, ["a", "c", "d"], "y", val, 2.0, p, ["c"])
    alone = fit()
    monkeypatch.setattr(boost, "ALONE_BYTES", 0)
    monkeypatch.setattr(boost, "RANKED", 2000)  # four trees a job
    jobs = fit()
    key = lambda m: [tuple(r) for r in m.nodes(spark).orderBy("tree", "node").collect()]
    assert key(alone) == key(jobs) and alone.scores == pytest.approx(jobs.scores)
    assert len(alone.scores) == alone.best_iteration + 5 < 40  # no tree beyond the stop


def test_jobs_merge_partitions_to_the_same_trees(spark, parts, monkeypatch):
    train, _ = parts
    p = boost.BoostParams(max_iter=2, max_depth=3, subsample=1.0, early_stopping_rounds=None)
    want = [t.value for t in boost.train_boosted(train, ["a", "c", "d"], "y", params=p, categorical=["c"]).trees]
    monkeypatch.setattr(boost, "ALONE_ROWS", 0)
    for rows, dense in ((300, 1 << 16), (15, 1 << 16), (300, 4)):  # several partitions, more than 64, sparse histograms
        monkeypatch.setattr(boost, "ROWS", rows)
        monkeypatch.setattr(boost, "_DENSE", dense)
        assert [t.value for t in boost.train_boosted(train, ["a", "c", "d"], "y", params=p, categorical=["c"]).trees] == want


def test_a_task_ranks_as_the_metrics_do(spark):
    cases = [[(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.9), (1, -2.0)], [(1, 0.3)] * 5, [(0, 0.3), (0, 0.2)], [(0, 1.0), (1, 0.0)]]
    for rows in cases:
        want = ranking_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s", fpr_targets=()).first()
        y, s = (boost.np.array(x) for x in zip(*rows))
        for metric in ("auc_pr", "auc_roc"):
            assert boost.ranked(y, s, metric) == pytest.approx(want[metric] or 0.0)


def test_an_empty_validation_part_keeps_one_tree(spark, parts):
    train, val = parts
    m = boost.train_boosted(train, ["a", "d"], "y", val.limit(0), params=boost.BoostParams(max_iter=9, max_depth=2, early_stopping_rounds=3))
    assert len(m.trees) == 1 and len(m.scores) == 4


def test_scenarios_are_fitted_side_by_side(spark, parts):
    import threading

    from rarefold.operators.experiment import run_ablation

    train, val = parts
    meet = threading.Barrier(2, timeout=60)

    def fit(rows):
        meet.wait()
        return boost.train_boosted(rows, ["a", "d"], "y", params=boost.BoostParams(max_iter=1, max_depth=2))

    got = run_ablation({"x": train, "z": train.where("id % 2 = 0")}, val, ["a", "d"], "y", fit)
    assert [tuple(r) for r in got.select("scenario", "n_train_samples").orderBy("scenario").collect()] == [("x", 1000), ("z", 500)]
