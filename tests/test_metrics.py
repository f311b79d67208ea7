import random

import pytest
from pyspark.sql import functions as F

from rarefold.operators import metrics as M

SCHEMA = "label int, score double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def record(spark, rows, **kw):
    return M.metric_row(frame(spark, rows), "label", "score", **kw).first().asDict(recursive=True)


def skewed(n, seed, share=0.2, digits=None):
    """Positives score higher on average; beta-shaped, not clipped."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < share)
        s = rng.betavariate(3 + 2 * y, 4)
        out.append((y, round(s, digits) if digits else s))
    return out


def pairs_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def stepwise_ap(rows):
    total, area, seen, hits = sum(y for y, _ in rows), 0.0, 0, 0
    for cut in sorted({s for _, s in rows}, reverse=True):
        own = [y for y, s in rows if s == cut]
        seen, hits = seen + len(own), hits + sum(own)
        area += sum(own) / total * hits / seen
    return area


def test_separated_classes(spark):
    # seven negatives below 0.4, three positives above 0.6: nothing is on the wrong side of one half
    rows = [(0, 0.05 * k) for k in range(7)] + [(1, 0.61), (1, 0.7), (1, 0.99)]
    got = record(spark, rows)
    assert (got["auc_roc"], got["auc_pr"], got["f1"], got["mcc"]) == pytest.approx((1, 1, 1, 1))
    assert got["confusion_matrix"] == {"tn": 7, "fp": 0, "fn": 0, "tp": 3}


def test_worked_by_hand(spark):
    # at 0.25: predicted 1 for 0.9(+), 0.5(-), 0.25(+), 0.25(-), 0.3(-); missed 0.1(+)
    rows = [(1, 0.9), (0, 0.5), (1, 0.25), (0, 0.25), (0, 0.3), (1, 0.1), (0, 0.0)]
    got = record(spark, rows, threshold=0.25, flat=True)
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (2, 3, 1, 1)
    assert got["precision"] == pytest.approx(2 / 5) and got["recall"] == pytest.approx(2 / 3) and got["f1"] == pytest.approx(0.5)
    # pairs won: 0.9 beats 4; 0.25 beats 0.0 and ties once; 0.1 beats 0.0
    assert got["auc_roc"] == pytest.approx((4 + 1.5 + 1) / 12)


@pytest.mark.parametrize("digits", [None, 1, 2])
def test_against_brute_force(spark, digits):
    rows = skewed(350, 31, digits=digits)
    got = record(spark, rows)
    assert got["auc_roc"] == pytest.approx(pairs_auc(rows)) and got["auc_pr"] == pytest.approx(stepwise_ap(rows))


def test_recall_never_falls_as_more_false_alarms_are_allowed(spark):
    targets = (0.001, 0.01, 0.05, 0.2, 0.5, 1.0)
    got = M.ranking_metrics(frame(spark, skewed(900, 5)), "label", "score", fpr_targets=targets).first()
    values = [got[M.fpr_key(t)] for t in targets]
    assert values == sorted(values) and values[-1] == 1


def test_record_has_the_contract_names(spark):
    got = record(spark, skewed(40, 8, share=0.5))
    assert list(got) == ["auc_roc", "auc_pr", "f1", "precision", "recall", "mcc", "confusion_matrix", "recall_at_fpr_1e-03", "recall_at_fpr_1e-04"]


def test_one_value_for_all(spark):
    got = record(spark, [(int(i % 4 == 0), 0.3) for i in range(12)])
    assert got["auc_roc"] == pytest.approx(0.5) and got["auc_pr"] == pytest.approx(0.25)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_alone(spark, label):
    got = record(spark, [(label, 0.2), (label, 0.4)])
    assert got["auc_roc"] is None and got["mcc"] == 0 and (got["auc_pr"] is None) == (label == 0)


@pytest.mark.parametrize("partitions", ["2", "8", "200"])
def test_missing_and_hot_scores_under_any_partitioning(spark, partitions):
    # a third of the scores is one value, a fifth is missing; "lowest" must act like a score below all others
    rng = random.Random(17)
    rows = [(int(rng.random() < 0.3), 0.5 if i % 3 == 0 else None if i % 5 == 0 else float("nan") if i % 7 == 0 else rng.random()) for i in range(300)]
    filled = [(y, -1.0 if s is None or s != s else s) for y, s in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = record(spark, rows, nulls="lowest")
        with pytest.raises(Exception, match="score or label is missing"):
            record(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["auc_roc"] == pytest.approx(pairs_auc(filled)) and got["auc_pr"] == pytest.approx(stepwise_ap(filled))
    assert sum(got["confusion_matrix"].values()) == 300


def test_counts_beyond_64_bits_as_products(spark):
    big = 4_000_000_000
    df = spark.createDataFrame([(1, 0.9, big), (0, 0.9, big), (0, 0.1, big)], "label int, score double, w long")
    got = M.ranking_metrics(df, "label", "score", weight="w").first()
    assert got["auc_roc"] == pytest.approx(0.75) and got["auc_pr"] == pytest.approx(0.5)


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.2), ("a", 0, 0.3)], "g string, label int, score double")
    got = {r.g: r.auc_roc for r in M.metric_row(df, "label", "score", group_cols=["g"]).collect()}
    assert got == {None: 1.0, "a": 0.0}


def test_moving_mean(spark):
    rng = random.Random(4)
    values = [rng.uniform(-5, 5) for _ in range(137)]
    df = spark.createDataFrame(list(enumerate(values)), "step int, reward double").repartition(5)
    got = {r.step: r.moving_avg for r in M.moving_average(df, "step", "reward", 9).collect()}
    assert all(got[i] is None for i in range(8))
    assert all(got[i] == pytest.approx(sum(values[i - 8 : i + 1]) / 9) for i in range(8, 137))


def test_moving_mean_across_blocks(spark):
    df = spark.range(25_000).select("id", (F.col("id") % 11).cast("double").alias("v"))
    got = M.moving_average(df, "id", "v", 20).where("id in (9999, 10000, 10018, 10019, 20005)").collect()
    assert {r.id: round(r.moving_avg, 9) for r in got} == {i: round(sum((j % 11) for j in range(i - 19, i + 1)) / 20, 9) for i in (9999, 10000, 10018, 10019, 20005)}
