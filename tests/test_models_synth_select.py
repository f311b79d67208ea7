import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators import oversample as O
from rarefold.operators import select as R
from rarefold.operators import synth as G
from rarefold.operators.model import PROBA, Classifier, gain_importance, train_classifier, train_linear
from rarefold.operators.weight import pos_weight


def test_pos_weight_auto(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "isFraud int")
    assert pos_weight(df, "isFraud") == pytest.approx(9.0)
    assert pos_weight(df, "isFraud", 3) == 3.0


def _xy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.zeros(200, dtype=int)
    y[rng.choice(200, 20, replace=False)] = 1
    rows = [tuple(map(float, r)) + (int(t), i) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "f0 double, f1 double, f2 double, f3 double, f4 double, isFraud int, id long")


def test_classifier_probabilities(spark, tmp_path):
    df = _xy(spark)
    tr, va = df.where("id < 150"), df.where("id >= 150")
    feats = [f"f{i}" for i in range(5)]
    clf = train_classifier(tr, feats, "isFraud", va, params=dict(max_iter=6, max_depth=3, early_stopping_rounds=3))
    p = [r[PROBA] for r in clf.predict_proba(va).collect()]
    assert len(p) == 50 and all(0.0 <= v <= 1.0 for v in p)
    path = str(tmp_path / "m")
    clf.save(path)
    again = Classifier.load(path, feats, "isFraud")
    assert [r[PROBA] for r in again.predict_proba(va).collect()] == p
    imp = gain_importance(path).collect()
    assert imp and all(r["gain"] >= 0 for r in imp)
    lin = train_linear(tr, feats, "isFraud")
    assert lin.predict_proba(va).count() == 50


def _minority(spark):
    rows = [(i, float(i % 7), float(i % 5), "a" if i % 2 else "b", 0) for i in range(40)]
    rows += [(100 + i, 10.0 + i, 20.0 - i, "a" if i % 3 else "b", 1) for i in range(8)]
    return spark.createDataFrame(rows, "id long, x double, z double, c string, y int")


def test_smote_counts_and_segments(spark):
    df = _minority(spark)
    out = O.smote_resample(df, "y", "id", ["x", "z"], ["c"], k=5, seed=1)
    assert out.count() == 80
    assert out.where("y = 1").count() == 40
    syn = O.smote(df, "y", "id", ["x", "z"], k=5, seed=1).collect()
    pts = [(r["x"], r["z"]) for r in df.where("y = 1").collect()]
    # every synthetic row lies on a segment between two minority rows: here x + z = 30 on all of them
    assert all(abs(r["x"] + r["z"] - 30.0) < 1e-9 for r in syn)
    assert all(min(p[0] for p in pts) <= r["x"] <= max(p[0] for p in pts) for r in syn)
    with pytest.raises(ValueError):
        O.smote(df.where("y = 0 or id < 103"), "y", "id", ["x", "z"], k=5)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(120, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double, c double")
    nn = O.knn_within(df, "id", ["a", "b", "c"], k=4).collect()
    got = {}
    for r in nn:
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor_id"]))
    for i in range(120):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(1))
        d[i] = np.inf
        exp = list(np.lexsort((np.arange(120), d))[:4])
        assert [n for _, n in sorted(got[i])] == exp


def test_hard_draw_is_one_hot_and_frequencies(spark):
    rows = spark.range(4000).select(G.gumbel_choice(["a", "b", "c"], [0.2, 0.5, 0.3], 1, "t", F.col("id")).alias("v"))
    counts = {r["v"]: r["count"] for r in rows.groupBy("v").count().collect()}
    assert set(counts) <= {"a", "b", "c"} and sum(counts.values()) == 4000
    assert abs(counts["b"] / 4000 - 0.5) < 0.04
    oh = spark.range(10).select(G.condition_vector(F.col("id") % 2).alias("v")).collect()
    assert all(sum(r["v"]) == 1.0 and len(r["v"]) == 2 for r in oh)


def test_mixture_sample_shape_and_realism(spark):
    df = _minority(spark)
    m = G.fit_mixture(df, "y", ["x", "z"], ["c"], k=2, seed=3)
    s = m.sample(spark, 30, "y", 1, seed=3)
    rows = s.collect()
    assert len(rows) == 30 and all(r["c"] in ("a", "b") and r["y"] == 1 and r[O.SYNTHETIC_FLAG] for r in rows)
    sc = G.realism_score(df.where("y = 1"), s, ["x", "z"]).collect()
    assert len(sc) == 38 and all(math.isfinite(r["realism"]) for r in sc)
    assert G.pca_projection(df.where("y = 1"), s, ["x", "z"]).count() == 38


def test_episodes_state_and_reward_rules(spark):
    pool = spark.range(10).select(F.col("id").alias("pid"), (F.col("id") * 1.0).alias("f0"), F.lit(1).alias("y"))
    eps = R.draw_episodes(pool, "pid", n_episodes=3, size=4, seed=1)
    assert {r["episode"]: r["count"] for r in eps.groupBy("episode").count().collect()} == {0: 4, 1: 4, 2: 4}
    st = R.running_state(eps.withColumn("keep", F.lit(True))).collect()
    assert all(r["ratio"] == (0.0 if r["position"] == 0 else 1.0) for r in st)
    obs = R.observation(pool.select("pid", F.array("f0", "f0", "f0").alias("obs")), R.running_state(eps.withColumn("keep", F.lit(False))), "pid")
    assert all(len(r["observation"]) == 3 + 2 for r in obs.collect())
    none_kept = eps.withColumn("keep", F.lit(False))
    raw = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.9)], "episode int, raw_score double")
    summ = R.episode_summary(none_kept, raw, 0.4).collect()
    assert all(r["reward"] == 0.0 and r["raw_score"] == 0.4 and r["n_selected"] == 0 for r in summ)
    all_kept = R.episode_summary(eps.withColumn("keep", F.lit(True)), raw, 0.4).collect()
    assert all(r["n_selected"] == 4 and r["reward"] == pytest.approx((0.9 - 0.4) / 0.4) for r in all_kept)


def test_category_draws_follow_the_counts(spark):
    from rarefold.functions.rng import uniform

    # 500 categories of falling frequency: each integer of 0 .. total - 1 must meet its own category
    counts = spark.createDataFrame([("c", f"v{i:03d}", 1 + (499 - i) // 50) for i in range(500)], "feature string, value string, n long")
    total = sum(1 + (499 - i) // 50 for i in range(500))
    rows = spark.range(total).select("id", "id", "id").toDF("id", "value", "cell")
    got = G.draw_categories(rows, G.draw_table(counts), "c", (F.col("id") + 0.5) / total).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {f"v{i:03d}": 1 + (499 - i) // 50 for i in range(500)}
    many = spark.range(200_000).withColumnRenamed("id", "k")
    drawn = G.draw_categories(many, G.draw_table(counts), "c", uniform(1, "t", "k"))
    assert drawn.count() == 200_000
    top = drawn.where("c = 'v000'").count()
    assert abs(top - 200_000 * 10 / total) < 5 * (200_000 * 10 / total) ** 0.5


def test_incomplete_rows_are_refused(spark):
    from rarefold.operators.oversample import knn_within, smote

    rows = [(i, float(i), None if i == 3 else 1.0, int(i < 9)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    for make in (lambda: knn_within(df, "id", ["x", "z"]), lambda: smote(df, "y", "id", ["x", "z"])):
        with pytest.raises(Exception, match="impute"):
            make().collect()
    even = smote(df.where("id >= 9").withColumn("y", (F.col("id") % 2).cast("int")).where("id < 29"), "y", "id", ["x"])
    assert dict(even.dtypes)["x"] == "double"


def test_bootstrap_against_plain_resampling(spark):
    import numpy as np

    from rarefold.operators import experiment as E

    rng = np.random.default_rng(4)
    rows = [(i, int(rng.random() < 0.3), 0.4 if i % 3 == 0 else round(float(rng.random()), 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, y int, s double")
    hashes = np.array([int(__import__("hashlib").md5(f"7|boot|{i}".encode()).hexdigest()[:12], 16) % 2147483647 for i, _, _ in rows])
    w = E._weights(hashes, np.arange(40))
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    got = {r.b: r for r in E.bootstrap_metrics(df, "y", "s", "id", 40, seed=7, fpr_targets=(0.1,)).collect()}
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for b in range(40):
        yy, ss = np.repeat(y, w[:, b]), np.repeat(s, w[:, b])
        pos, neg = ss[yy == 1], ss[yy == 0]
        cuts = sorted(set(ss), reverse=True)
        tp = np.array([(pos >= c).sum() for c in cuts])
        fp = np.array([(neg >= c).sum() for c in cuts])
        assert got[b].auc_pr == pytest.approx((np.diff(tp, prepend=0) / len(pos) * tp / (tp + fp)).sum())
        assert got[b].auc_roc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg))
        assert got[b]["recall_at_fpr_1e-01"] == pytest.approx(max([0, *tp[fp <= 0.1 * len(neg)]]) / len(pos))
        assert got[b].precision == pytest.approx((pos >= 0.5).sum() / max(1, (ss >= 0.5).sum()))
    r = E.bootstrap_ci(df, "y", "s", "id", lambda t: F.col("recall") - F.col("precision"), 40, seed=7).first()
    assert r.lower <= r["mean"] <= r.upper


def test_linear_report_covers_all_test_rows(spark, tmp_path, monkeypatch):
    from rarefold.plans import q_model

    e = spark.range(14_000).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id * 37 % 101 as user_id", "case when id % 3 = 0 then 'purchase' else 'view' end as event_type", "cast(id * 53 % 211 as double) as value", "'' as props"
    )
    e.write.parquet(str(tmp_path / "events.parquet"))
    seen, whole = [], q_model.C.linear_contributions
    monkeypatch.setattr(q_model.C, "linear_contributions", lambda clf, view, *a: seen.append(view.count()) or whole(clf, view, *a))
    assert q_model.q_top_features_linear(spark, str(tmp_path)).count() > 0
    assert seen == [2100]
