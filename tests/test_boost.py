import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators.boost import CATEGORY, Boosted, BoostParams, category_columns, in_sample, train_boosted, tree_features
from rarefold.operators.metrics import ranking_metrics


def plain_tree(x, y, margin, rows, features, category, weight, p):
    """One tree by exhaustive search over plain lists; a node is (feature, left test set, left, right) or a value."""
    w = [weight if t else 1.0 for t in y]
    q = [1 / (1 + math.exp(-m)) for m in margin]
    g, h = [a * (b - t) for a, b, t in zip(w, q, y)], [a * b * (1 - b) for a, b in zip(w, q)]
    score = lambda own: sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + p.reg_lambda)

    def grow(own, depth):
        best = None
        for f in features if depth < p.max_depth else []:
            values = sorted({x[i][f] for i in own})
            if category[f]:
                ratio = lambda v: (sum(g[i] for i in own if x[i][f] == v) / (sum(h[i] for i in own if x[i][f] == v) + p.reg_lambda), v)
                values.sort(key=ratio)
            for k in range(1, len(values)):
                go = set(values[:k])
                left, right = [i for i in own if x[i][f] in go], [i for i in own if x[i][f] not in go]
                if min(sum(h[i] for i in left), sum(h[i] for i in right)) < p.min_child_weight:
                    continue
                gain = 0.5 * (score(left) + score(right) - score(own))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, go, left, right)
        if best is None:
            return -p.step_size * sum(g[i] for i in own) / (sum(h[i] for i in own) + p.reg_lambda)
        _, f, go, left, right = best
        return f, go, grow(left, depth + 1), grow(right, depth + 1)

    return grow(rows, 0)


def same(tree, k, plain, x, rows):
    if not isinstance(plain, tuple):
        assert tree.feature[k] == -1 and tree.value[k] == pytest.approx(plain, abs=1e-6)
        return
    f, go, left, right = plain
    assert tree.feature[k] == f
    goes = lambda v: v in tree.categories[k] if tree.categories[k] is not None else v <= tree.cut[k]
    assert {v for v in {x[i][f] for i in rows} if goes(v)} == go
    same(tree, tree.left[k], left, x, [i for i in rows if x[i][f] in go])
    same(tree, tree.right[k], right, x, [i for i in rows if x[i][f] not in go])


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c = rng.gauss(0, 1), rng.randrange(5), rng.randrange(7)
        y = int(rng.random() < (0.7 if c in (1, 4, 6) else 0.1) * (1.3 if a > 0.4 else 0.7))
        rows.append((a, float(b), c, rng.random(), y))
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, y int").coalesce(1)
    return rows, df.withColumn("c", F.col("c").alias("c", metadata=CATEGORY))


FEATURES = ["a", "b", "c", "d"]


@pytest.mark.parametrize("p", [BoostParams(max_iter=4, max_depth=3, early_stopping_rounds=None, block=2, step_size=0.3), BoostParams(max_iter=3, max_depth=4, early_stopping_rounds=None, min_child_weight=1.0, subsample=1.0, colsample=0.5, step_size=0.3)])
def test_same_trees_as_plain_python(spark, table, p):
    rows, df = table
    m = train_boosted(df, FEATURES, "y", weight=2.5, params=p)
    x = m.bins(np.array([r[:4] for r in rows], float)).tolist()
    # the rows as the staged table numbers them: one partition, written in the given order up to the shuffle of repartition(1)
    y, margin, category = [r[4] for r in rows], [0.0] * len(rows), [False, False, True, False]
    number = list(range(len(rows)))
    for k, tree in enumerate(m.trees):
        own = [i for i, s in zip(number, in_sample(np.arange(len(rows)), k, p)) if s]
        same(tree, 0, plain_tree(x, y, margin, own, tree_features(4, k, p), category, 2.5, p), x, own)
        step = tree.margins(np.array(x))
        margin = [a + b for a, b in zip(margin, step)]


def test_partitioning_changes_nothing_that_sampling_does_not(spark, table):
    _, df = table
    p = BoostParams(max_iter=3, max_depth=3, subsample=1.0, early_stopping_rounds=None)
    one, many = train_boosted(df, FEATURES, "y", params=p), train_boosted(df.repartition(7), FEATURES, "y", params=p)
    key = lambda m: [(r.tree, r.node, r.feature, r.cut, r.categories, r.value) for r in m.nodes(spark).orderBy("tree", "node").collect()]
    assert key(one) == key(many)


def test_planted_rule_on_unordered_codes_is_one_split(spark):
    good = {3, 8, 11, 17, 40}
    df = spark.range(2000).select((F.col("id") % 50).cast("int").alias("c", metadata=CATEGORY), ((F.col("id") % 50).isin(*good)).cast("int").alias("y"))
    assert category_columns(df, ["c"]) == {"c"}
    m = train_boosted(df, ["c"], "y", params=BoostParams(max_iter=1, max_depth=1, colsample=1.0, early_stopping_rounds=None))
    t = m.trees[0]
    left = {b - 1 for b in t.categories[0].tolist()}  # bins are codes plus one
    sets = [left, set(range(50)) - left]
    assert good in sets and len(t.feature) == 3
    ordered = train_boosted(df, ["c"], "y", params=BoostParams(max_iter=1, max_depth=1, early_stopping_rounds=None), categorical=[])
    assert ordered.trees[0].gain[0] < t.gain[0]


def test_stops_at_the_best_round_of_a_plain_loop(spark, table, tmp_path):
    rows, df = table
    train, val = df.limit(300), spark.createDataFrame(rows[300:], "a double, b double, c int, d double, y int")
    p = BoostParams(max_iter=30, max_depth=3, early_stopping_rounds=6, step_size=0.3, block=4, min_child_weight=1.0)
    m = train_boosted(train, FEATURES, "y", val, params=p)
    every = train_boosted(train, FEATURES, "y", params=BoostParams(**{**p.__dict__, "early_stopping_rounds": None, "max_iter": len(m.scores)}))
    seen = []
    for k in range(1, len(every.trees) + 1):
        cut = Boosted(every.trees[:k], every.features, every.cuts, "y")
        seen.append(ranking_metrics(cut.predict_proba(val), "y", "fraud_probability", fpr_targets=()).first()["auc_pr"])
    assert m.scores == pytest.approx(seen)
    best, since, top = 0, 0, -1.0
    for i, s in enumerate(seen):
        best, top, since = (i, s, 0) if s > top else (best, top, since + 1)
        if since >= 6:
            break
    assert m.best_iteration == best + 1 == len(m.trees)
    again = Boosted.load(m.save(str(tmp_path / "m")))
    a, b = (x.predict_proba(val).select("fraud_probability").toPandas() for x in (m, again))
    assert a.equals(b) and a["fraud_probability"].between(0, 1).all()


def test_loss_falls_and_awkward_rows(spark, table):
    _, df = table
    m = train_boosted(df, FEATURES, "y", params=BoostParams(max_iter=8, max_depth=3, subsample=1.0, colsample=1.0, early_stopping_rounds=None))
    last = math.inf
    for k in range(9):
        q = F.col("fraud_probability")
        loss = Boosted(m.trees[:k], m.features, m.cuts, "y").predict_proba(df).agg(F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q)))).first()[0]
        assert loss < last
        last = loss
    odd = spark.createDataFrame([(None, float("nan"), None, float("inf"), 1), (1.0, 2.0, 99, -1.0, 0)], "a double, b double, c int, d double, y int")
    assert m.predict(odd).where("fraud_prediction in (0, 1)").count() == 2
    assert m.predict(odd.limit(0)).count() == 0 and m.batch_predict(odd.limit(0)).columns[-1] == "fraud_probability"
    some = df.withColumn("c", F.when(F.col("c") != 2, F.col("c")).alias("c", metadata=CATEGORY))
    assert train_boosted(some, FEATURES, "y", params=BoostParams(max_iter=2, max_depth=2, early_stopping_rounds=None)).predict(some).count() == 400
    flat = spark.createDataFrame([(1.0, 1)] * 20, "a double, y int")
    assert all(t.feature == [-1] for t in train_boosted(flat, ["a"], "y", params=BoostParams(max_iter=2, early_stopping_rounds=None)).trees)
    with pytest.raises(ValueError):
        train_boosted(flat.limit(0), ["a"], "y")
    with pytest.raises(ValueError):
        train_boosted(odd.withColumn("y", F.lit(None).cast("int")), ["a"], "y")


def test_partitions_merge_to_the_same_trees(spark, table, monkeypatch):
    from rarefold.operators import boost

    _, df = table
    p = BoostParams(max_iter=2, max_depth=3, subsample=1.0, early_stopping_rounds=None)
    want = [t.value for t in train_boosted(df, FEATURES, "y", params=p).trees]
    for rows, dense in ((100, 1 << 16), (5, 1 << 16), (100, 4)):  # several partitions, more than 64, sparse histograms
        monkeypatch.setattr(boost, "ROWS", rows)
        monkeypatch.setattr(boost, "_DENSE", dense)
        assert [t.value for t in train_boosted(df, FEATURES, "y", params=p).trees] == want
