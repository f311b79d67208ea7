"""Exact contributions of boosted trees (C9): path-dependent Shapley values, computed leaf by leaf.

A leaf's value is reached if the row meets the conditions of the distinct features on its path. If a feature is unknown, the
row goes each way in proportion to the training weight there, so a leaf has a share per feature. For a path of d
features there are 2^d ways in which a row can meet them; the Shapley values of each way are worked out when a task comes to
the leaf, and a row only looks up its way. Tasks receive the leaves' conditions alone, some hundred bytes each and ``MAX_BYTES``
in all, and hold one table of 2^d x d numbers at a time. Contributions and the base value add up to the margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.operators.boost import Boosted, Tree
from rarefold.operators.model import Classifier
from rarefold.session import scratch_path

#: Tree nodes that may be sent to tasks (a few tens of bytes each); the declared models have at most 254,000.
MAX_NODES = 1_000_000


#: Bytes of leaves that may be sent to tasks; the declared models have at most 128,000 leaves of some 300 bytes.
MAX_BYTES = 64 << 20


@dataclass
class _Leaf:
    features: np.ndarray  # distinct features on the path
    low: np.ndarray  # met if low < x <= high
    high: np.ndarray
    share: np.ndarray  # of the training weight that meets the feature's conditions
    value: float
    sets: dict[int, list[tuple[np.ndarray, bool]]]  # place in features -> codes, and whether x is among them

    @property
    def base(self) -> float:
        return self.value * float(self.share.prod())

    @property
    def nbytes(self) -> int:
        return 100 + sum(a.nbytes for a in (self.features, self.low, self.high, self.share)) + sum(100 + codes.nbytes for own in self.sets.values() for codes, _ in own)

    def ways(self, x: np.ndarray) -> np.ndarray:
        """For each row which conditions it meets, as a number of d bits."""
        own = x[:, self.features]
        met = (own > self.low) & (own <= self.high)
        for k, tests in self.sets.items():
            for codes, inside in tests:
                met[:, k] &= np.isin(own[:, k], codes) == inside
        return (met << np.arange(len(self.features))).sum(axis=1)

    @property
    def table(self) -> np.ndarray:
        """way x feature -> contribution"""
        share, d = self.share, len(self.features)
        met = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
        table = np.zeros((1 << d, d))
        weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
        for i in range(d):
            sums = np.zeros((1 << d, d))  # by size of the known set among the other features
            sums[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    sums[:, 1:] = sums[:, 1:] * share[j] + sums[:, :-1] * met[:, j : j + 1]
                    sums[:, 0] *= share[j]
            table[:, i] = self.value * (met[:, i] - share[i]) * (sums * weight).sum(axis=1)
        return table


def _leaf(value: float, path: dict[int, tuple[float, float, float]], sets: dict[int, list] | None = None) -> _Leaf:
    features = np.array(sorted(path), dtype=np.int64)
    low, high, share = (np.array([path[f][k] for f in features]) for k in range(3))
    return _Leaf(features, low, high, share, value, {k: sets[f] for k, f in enumerate(features.tolist()) if sets and f in sets})


def _boosted_leaves(t: Tree) -> Iterator[_Leaf]:
    """Leaves of a tree on bins; a set of categories narrows its feature's conditions like an interval does."""
    todo: list[tuple[int, dict, dict]] = [(0, {}, {})]
    while todo:
        i, path, sets = todo.pop()
        f = t.feature[i]
        if f < 0:
            yield _leaf(t.value[i], path, sets)
            continue
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, inside in ((t.left[i], True), (t.right[i], False)):
            part = share * t.cover[child] / t.cover[i]
            if t.categories[i] is not None:
                todo.append((child, {**path, f: (low, high, part)}, {**sets, f: [*sets.get(f, []), (t.categories[i], inside)]}))
            else:
                own = (low, min(high, t.cut[i])) if inside else (max(low, t.cut[i]), high)
                todo.append((child, {**path, f: (*own, part)}, sets))


def _leaves(nodes: list, weight: float) -> Iterator[_Leaf]:
    by = {n["id"]: n for n in nodes}
    cover = {i: n["impurityStats"][0] for i, n in by.items()}
    todo = [(0, {})]
    while todo:
        i, path = todo.pop()
        n = by[i]
        if n["leftChild"] < 0:
            yield _leaf(n["prediction"] * weight, path)
            continue
        if n["split"]["numCategories"] != -1:
            raise ValueError("contributions are for trees on numeric features")
        f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, lo, hi in ((n["leftChild"], low, min(high, cut)), (n["rightChild"], max(low, cut), high)):
            todo.append((child, {**path, f: (lo, hi, share * cover[child] / cover[i])}))


def _model_leaves(clf: Classifier | Boosted, spark) -> list[_Leaf]:
    if isinstance(clf, Boosted):
        return [leaf for t in clf.trees for leaf in _boosted_leaves(t)]
    gbt = clf.model.stages[-1]
    if not isinstance(gbt, GBTClassificationModel):
        raise TypeError("tree contributions need a boosted tree model")
    if gbt.totalNumNodes > MAX_NODES:
        raise ValueError(f"{gbt.totalNumNodes} tree nodes are more than {MAX_NODES}")
    path = scratch_path(spark, "trees")
    gbt.write().save(path)
    trees: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").collect():  # bounded above
        trees.setdefault(r["treeID"], []).append(r["nodeData"])
    return [leaf for t, w in enumerate(gbt.treeWeights) for leaf in _leaves(trees[t], w)]


def tree_contributions(clf: Classifier | Boosted, view: DataFrame, id_col: str) -> tuple[DataFrame, float]:
    """(id, feature, contribution) for every row of a classifier view, and the base value.

    Per row, contributions + base = the margin (``rawPrediction[1]``). (the boosted trees' margin). The leaves are sent to the tasks once.
    """
    spark = view.sparkSession
    leaves = _model_leaves(clf, spark)
    if sum(leaf.nbytes for leaf in leaves) > MAX_BYTES:
        raise ValueError(f"the leaves take more than {MAX_BYTES} bytes")
    shared = spark.sparkContext.broadcast(leaves)
    names = clf.features
    binned = clf.bins if isinstance(clf, Boosted) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = part[[f"x{i}" for i in range(len(names))]].to_numpy(float)
            out = np.zeros_like(x)
            if binned:
                x = binned(x)
            for leaf in shared.value:
                out[:, leaf.features] += leaf.table[leaf.ways(x)]
            yield pd.DataFrame({"id": part["id"].to_numpy(), "c": list(out)})

    kind = view.schema[id_col].dataType.simpleString()
    rows = view.select(F.col(id_col).alias("id"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(names)])
    made = rows.mapInPandas(run, f"id {kind}, c array<double>")
    cells = F.arrays_zip(F.array(*[F.lit(f) for f in names]).alias("feature"), F.col("c").alias("contribution"))
    long = made.select(F.col("id").alias(id_col), F.explode(cells).alias("r")).select(id_col, F.col("r.feature").alias("feature"), F.col("r.contribution").alias("contribution"))
    return long, float(sum(leaf.base for leaf in leaves))
