import itertools
import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rarefold.operators.attribution import _leaves, tree_contributions
from rarefold.operators.model import top_features, train_fast_classifier


def expected(nodes, x, known, i=0):
    """Value of a tree if only ``known`` features of x are known."""
    n = nodes[i]
    if n["leftChild"] < 0:
        return n["prediction"]
    left, right = n["leftChild"], n["rightChild"]
    f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return expected(nodes, x, known, left if x[f] <= cut else right)
    return sum(nodes[c]["impurityStats"][0] * expected(nodes, x, known, c) for c in (left, right)) / n["impurityStats"][0]


def random_tree(rng, depth, features):
    nodes = []

    def grow(d, cover):
        i = len(nodes)
        nodes.append(None)
        if d == 0 or rng.random() < 0.15:
            nodes[i] = {"id": i, "prediction": rng.uniform(-1, 1), "impurityStats": [cover], "leftChild": -1, "rightChild": -1, "split": None}
        else:
            share = rng.uniform(0.1, 0.9)
            split = {"featureIndex": rng.randrange(features), "leftCategoriesOrThreshold": [rng.uniform(0, 1)], "numCategories": -1}
            nodes[i] = {"id": i, "prediction": 0.0, "impurityStats": [cover], "split": split}
            nodes[i] |= {"leftChild": grow(d - 1, cover * share), "rightChild": grow(d - 1, cover * (1 - share))}
        return i

    grow(depth, 100.0)
    return nodes


def test_leaf_tables_against_all_subsets():
    rng = random.Random(5)
    for _ in range(25):
        nodes, m = random_tree(rng, 4, 4), 4
        by = {n["id"]: n for n in nodes}
        leaves = list(_leaves(nodes, 1.0))
        assert sum(leaf.base for leaf in leaves) == pytest.approx(expected(by, None, set()))
        x = [rng.uniform(0, 1) for _ in range(m)]
        got = [0.0] * m
        for leaf in leaves:
            way = sum(1 << k for k, f in enumerate(leaf.features) if leaf.low[k] < x[f] <= leaf.high[k])
            for k, f in enumerate(leaf.features):
                got[f] += leaf.table[way, k]
        for i in range(m):
            others, want = [f for f in range(m) if f != i], 0.0
            for r in range(m):
                for s in itertools.combinations(others, r):
                    w = math.factorial(r) * math.factorial(m - r - 1) / math.factorial(m)
                    want += w * (expected(by, x, {*s, i}) - expected(by, x, set(s)))
            assert got[i] == pytest.approx(want)


def test_contributions_add_up_to_the_margin(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a, b, c = rng.random(), rng.randrange(4), rng.gauss(0, 1)
        rows.append((i, a, b, c, int(a + 0.3 * b + 0.2 * rng.gauss(0, 1) > 0.9)))
    df = spark.createDataFrame(rows, "id long, a double, b int, c double, y int")
    clf = train_fast_classifier(df, ["a", "b", "c"], "y", dict(max_iter=6, max_depth=3))
    long, base = tree_contributions(clf, df, "id")
    total = {r.id: r.s for r in long.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    margin = {r.id: r.m for r in clf.model.transform(df.withColumn("y", F.col("y").cast("double"))).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert len(total) == 300 and all(total[i] + base == pytest.approx(margin[i]) for i in margin)
    assert [r.feature for r in top_features(long, 3).collect()][2] == "c"


def test_boosted_trees_with_categories_add_up(spark):
    import numpy as np

    from rarefold.operators.attribution import _boosted_leaves
    from rarefold.operators.boost import BoostParams, train_boosted

    rng = random.Random(4)
    rows = []
    for i in range(400):
        a, c = rng.random(), rng.randrange(9)
        rows.append((i, a, c, rng.gauss(0, 1), int((c in (2, 5, 7)) + a + 0.4 * rng.gauss(0, 1) > 1.1)))
    df = spark.createDataFrame(rows, "id long, a double, c int, d double, y int")
    m = train_boosted(df, ["a", "c", "d"], "y", weight=2.0, params=BoostParams(max_iter=5, max_depth=4, min_child_weight=1.0, colsample=1.0, early_stopping_rounds=None), categorical=["c"])
    long, base = tree_contributions(m, df, "id")
    total = {r.id: r.s for r in long.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    margin = {r.id: r.m for r in m.margin(df, "m").collect()}
    assert len(total) == 400 and all(total[i] + base == pytest.approx(margin[i]) for i in margin)
    assert {r.feature for r in top_features(long, 2).collect()} == {"a", "c"}

    def value(t, x, known, i=0):
        f = t.feature[i]
        if f < 0:
            return t.value[i]
        if f in known:
            goes = x[f] in t.categories[i] if t.categories[i] is not None else x[f] <= t.cut[i]
            return value(t, x, known, t.left[i] if goes else t.right[i])
        return sum(t.cover[k] * value(t, x, known, k) for k in (t.left[i], t.right[i])) / t.cover[i]

    x = m.bins(np.array([r[1:4] for r in rows[:20]], float))
    t = m.trees[0]
    for row in x:
        got = np.zeros(3)
        for leaf in _boosted_leaves(t):
            got[leaf.features] += leaf.table[leaf.ways(row[None, :])][0]
        for i in range(3):
            others = [f for f in range(3) if f != i]
            want = sum(math.factorial(r) * math.factorial(2 - r) / 6 * (value(t, row, {*s, i}) - value(t, row, set(s))) for r in range(3) for s in itertools.combinations(others, r))
            assert got[i] == pytest.approx(want)
