"""Synthetic minority rows (G1-G10), re-aimed from a neural generator to Spark jobs.

* G2/G3: per class, ``GaussianMixture`` on the standardised numeric vector and,
  from hard assignments, joint category counts along the tree of column pairs with
  the most mutual information given the component.
* G4/G6/G7: rows drawn from ``spark.range`` with portable hashes: component by
  Gumbel-max over the few weights, numeric = mean + Cholesky * normal noise,
  categories from the tree's root down, by inverse-CDF draws joined on guide tables.
* G8: a column-independent baseline (inverse empirical CDF per numeric column).
* G9/G10: realism as a real-vs-synthetic classifier margin; a joint PCA.

Means and covariances are per-component sized and are embedded in the projection
as literals; category counts stay tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.functions.prefix import global_row_number, null_safe_join, running_totals
from rarefold.functions.rng import TWO48, uniform
from rarefold.operators.join import stack_with_origin
from rarefold.operators.oversample import SYNTHETIC_FLAG
from rarefold.session import cut_lineage, staged

# Reference sampling settings (fixed values)
TARGET_CLASS = 1
OVERSAMPLE_RATIO = 1.0
CANDIDATE_MULTIPLIER = 3
LATENT_DIM = 64


def pool_size_frame(df: DataFrame, target: str, target_class: int = TARGET_CLASS, ratio: float = OVERSAMPLE_RATIO, multiplier: int = CANDIDATE_MULTIPLIER) -> DataFrame:
    """G1: one row ``pool_size`` = int(n_minority * ratio * multiplier)."""
    n = F.count_if(F.col(target) == target_class)
    return df.agg(F.floor(n.cast("double") * F.lit(float(ratio)) * F.lit(float(multiplier))).cast("long").alias("pool_size"))


def latent_noise(spark, n: int, dim: int = LATENT_DIM, seed: int = 42) -> DataFrame:
    """N x dim standard normal draws as (id, noise ARRAY<DOUBLE>)."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _normal_key(seed, "noise", F.col("id"), i)).alias("noise"))


def condition_vector(label: Column | str, n_classes: int = 2) -> Column:
    """One-hot of the class label."""
    c = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == c).cast("float"))


def _u_key(seed, salt: str, *parts: Column) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint").cast("double") / F.lit(TWO48)


def _normal_key(seed, salt: str, *parts: Column) -> Column:
    u1 = _u_key(seed, salt + ":a", *parts)
    u2 = _u_key(seed, salt + ":b", *parts)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gumbel_choice(values: Sequence, probs: Sequence[float], seed, salt: str, row: Column) -> Column:
    """One of a few values drawn with its probability (Gumbel-max: argmax ln p - ln(-ln u)); for many see ``draw_categories``."""
    vals = F.array(*[F.lit(v) for v in values])
    scores = F.array(
        *[
            (F.lit(math.log(p)) - F.log(-F.log(_u_key(seed, salt, row, F.lit(i)) + F.lit(1e-300)))) if p > 0 else F.lit(-math.inf)
            for i, p in enumerate(probs)
        ]
    )
    return F.element_at(vals, F.array_position(scores, F.array_max(scores)).cast("int"))


def category_counts(df: DataFrame, cat_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., feature, value, n): category counts per group, one pass (long form)."""
    long = df.select(*group_cols, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cat_cols])).alias("r"))
    return long.select(*group_cols, "r.feature", "r.value").groupBy(*group_cols, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def draw_table(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Guide table of inverse-CDF draws: (group..., feature, cell, value, lo, hi, total, cells).

    Per group and feature, categories in value order own the integers lo .. hi - 1 of 0 .. total - 1, cut into as many equal
    cells as there are categories; a category is listed in each cell it touches, so there are at most two rows a category.
    """
    g = [*group_cols, "feature"]
    cum = running_totals(counts, "value", {"hi": F.col("n")}, partition_by=g, unique=True)
    sizes = counts.groupBy(*g).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    t = null_safe_join(cum, sizes, g).withColumn("lo", F.col("hi") - F.col("n"))
    cell = lambda i: F.floor(i * F.col("cells") / F.col("total")).cast("long")
    return t.select(*g, "value", "lo", "hi", "total", "cells", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))


def draw_categories(rows: DataFrame, table: DataFrame, feature: str, u: Column, group_cols: Sequence[str] = (), few_groups: bool = True) -> DataFrame:
    """``rows`` plus column ``feature``: the category at integer floor(u * total) of its group. One join, by cell."""
    names = {c: f"__{c}" for c in ("cell", "lo", "hi", "total", "cells")} | {"value": feature}
    t = table.where(F.col("feature") == feature).select(*group_cols, *[F.col(c).alias(n) for c, n in names.items()])
    sizes = t.select(*group_cols, "__total", "__cells").distinct()
    if group_cols:
        sized = rows.join(F.broadcast(sizes) if few_groups else sizes, list(group_cols))  # few: as many as mixture components
    else:
        r = sizes.first()
        sized = rows.withColumns({"__total": F.lit(r["__total"] if r else 1), "__cells": F.lit(r["__cells"] if r else 1)})
    sized = sized.withColumn("__i", F.floor(u * F.col("__total")).cast("long"))
    sized = sized.withColumn("__cell", F.floor(F.col("__i") * F.col("__cells") / F.col("__total")).cast("long")).drop("__total", "__cells")
    hit = sized.join(t.drop("__total", "__cells"), [*group_cols, "__cell"]).where((F.col("__lo") <= F.col("__i")) & (F.col("__i") < F.col("__hi")))
    return hit.drop("__lo", "__hi", "__cell", "__i")


# ---------------------------------------------------------------- joint categories
def pair_counts(df: DataFrame, cat_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., first_feature, first_value, second_feature, second_value, n): counts of value pairs of every two columns, one pass."""
    text = lambda c: F.col(c).cast("string")
    pairs = [
        F.struct(F.lit(a).alias("first_feature"), text(a).alias("first_value"), F.lit(b).alias("second_feature"), text(b).alias("second_value"))
        for i, a in enumerate(cat_cols)
        for b in cat_cols[i + 1 :]
    ]
    long = df.select(*group_cols, F.explode(F.array(*pairs)).alias("r")).select(*group_cols, "r.*")
    return long.groupBy(*group_cols, "first_feature", "first_value", "second_feature", "second_value").agg(F.count(F.lit(1)).alias("n"))


def mutual_information(pairs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(first_feature, second_feature, information): mutual information in nats given the group, from ``pair_counts``."""
    both = [*group_cols, "first_feature", "second_feature"]
    out = pairs
    for keys, name in (([*both, "first_value"], "__first"), ([*both, "second_value"], "__second"), (both, "__all")):
        out = null_safe_join(out, pairs.groupBy(*keys).agg(F.sum("n").cast("double").alias(name)), keys)
    term = F.col("n") * F.log(F.col("n").cast("double") * F.col("__all") / (F.col("__first") * F.col("__second")))
    return out.groupBy("first_feature", "second_feature").agg((F.sum(term) / F.sum("n")).alias("information"))


def spanning_tree(information: DataFrame, cat_cols: Sequence[str]) -> list[tuple[str, str | None]]:
    """(column, parent) in drawing order: the spanning tree with the most information, from the first column down.

    Equal information (to 9 digits) goes to the pair that comes first in column order. One row a pair of columns reaches the driver.
    """
    at = {c: i for i, c in enumerate(cat_cols)}
    rows = sorted(information.collect(), key=lambda r: (-round(r["information"], 9), at[r["first_feature"]], at[r["second_feature"]]))
    tree: list[tuple[str, str | None]] = [(cat_cols[0], None)]
    inside = {cat_cols[0]}
    while len(inside) < len(cat_cols):
        edges = [(r["first_feature"], r["second_feature"]) for r in rows if (r["first_feature"] in inside) != (r["second_feature"] in inside)]
        if edges:
            parent, child = edges[0] if edges[0][0] in inside else edges[0][::-1]
        else:  # no rows were counted
            parent, child = cat_cols[0], next(c for c in cat_cols if c not in inside)
        tree.append((child, parent))
        inside.add(child)
    return tree


def information_tree(pairs: DataFrame, cat_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(first_feature, second_feature, information, in_tree) for every pair of columns."""
    info = cut_lineage(mutual_information(pairs, group_cols))
    chosen = F.lit(False)
    for child, parent in spanning_tree(info, cat_cols)[1:]:
        ends = F.array(F.col("first_feature"), F.col("second_feature"))
        chosen = chosen | (F.array_contains(ends, child) & F.array_contains(ends, parent))
    return info.withColumn("in_tree", chosen)


def _given(parent: str) -> Column:
    """The parent's value as a join key that is never null."""
    return F.when(F.col(parent).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(parent)))


@dataclass
class JointCategories:
    """Draw tables along a dependency tree: the root by group, every other column by group and its parent's value."""

    tree: list[tuple[str, str | None]]
    tables: dict[str, DataFrame]
    group_cols: list[str]

    def draw(self, rows: DataFrame, seed, salt: str, id_col: str) -> DataFrame:
        """``rows`` with a value of every column, drawn by the hash of seed, salt, column and row id."""
        for child, parent in self.tree:
            u = uniform(seed, f"{salt}-{child}", id_col)
            if parent is None:
                rows = draw_categories(rows, self.tables[child], child, u, self.group_cols)
            else:
                keyed = rows.withColumn("__given", _given(parent))
                rows = draw_categories(keyed, self.tables[child], child, u, [*self.group_cols, "__given"], few_groups=False).drop("__given")
        return rows


def fit_joint(counts: DataFrame, pairs: DataFrame, cat_cols: Sequence[str], group_cols: Sequence[str] = ()) -> JointCategories:
    """Dependency tree and its draw tables from ``category_counts`` and ``pair_counts`` (of the same rows and groups)."""
    g = list(group_cols)
    tree = spanning_tree(mutual_information(pairs, g), cat_cols) if len(cat_cols) > 1 else [(cat_cols[0], None)]
    tables = {}
    for child, parent in tree:
        if parent is None:
            tables[child] = staged(draw_table(counts.where(F.col("feature") == child), g), "draws")
            continue
        near, far = ("first", "second") if list(cat_cols).index(parent) < list(cat_cols).index(child) else ("second", "first")
        own = pairs.where((F.col(f"{near}_feature") == parent) & (F.col(f"{far}_feature") == child))
        own = own.select(*g, _given(f"{near}_value").alias("__given"), F.lit(child).alias("feature"), F.col(f"{far}_value").alias("value"), "n")
        tables[child] = staged(draw_table(own, [*g, "__given"]), "draws")
    return JointCategories(tree, tables, g)


def joint_sample(df: DataFrame, cat_cols: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of categories with the pair frequencies of ``df`` along its dependency tree."""
    model = fit_joint(category_counts(df, cat_cols), staged(pair_counts(df, cat_cols), "pairs"), cat_cols)
    rows = df.sparkSession.range(n).withColumnRenamed("id", "synthetic_id")
    return model.draw(rows, seed, "joint", "synthetic_id").select("synthetic_id", *cat_cols)


# ---------------------------------------------------------------- G8 marginal sampler
def marginal_sample(minority: DataFrame, id_col: str, num_cols: Sequence[str], cat_cols: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """N rows, columns independent. Numeric: the value at rank floor(u * n_c) of the column's sorted non-null values (ties
    by id), all columns in one ranked long table; categorical: inverse-CDF draws on the minority counts."""
    spark = minority.sparkSession
    out = spark.range(n).withColumnRenamed("id", "synthetic_id")
    if num_cols:
        cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in num_cols]
        long = minority.select(F.col(id_col).alias("__id"), F.explode(F.array(*cells)).alias("r")).select("__id", "r.feature", "r.v").where(F.col("v").isNotNull())
        ranked = global_row_number(long, "v", "__id", partition_by=["feature"], out="__r").select("feature", "__r", "v")
        sizes = {r["feature"]: r["n"] for r in long.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
        wanted = [F.struct(F.lit(c).alias("feature"), (F.floor(uniform(seed, f"marginal-{c}", "synthetic_id") * F.lit(sizes.get(c, 0))).cast("long") + 1).alias("__r")) for c in num_cols]
        picks = out.select("synthetic_id", F.explode(F.array(*wanted)).alias("w")).select("synthetic_id", "w.feature", "w.__r")
        values = picks.join(ranked, ["feature", "__r"]).groupBy("synthetic_id").agg(*[F.max(F.when(F.col("feature") == c, F.col("v"))).alias(c) for c in num_cols])
        out = out.join(values, "synthetic_id")
    if cat_cols:
        table = draw_table(category_counts(minority, cat_cols))
        for c in cat_cols:
            out = draw_categories(out, table, c, uniform(seed, f"marginal-{c}", "synthetic_id"))
    return out


# ---------------------------------------------------------------- G2/G7 mixture sampler
@dataclass
class MixtureSampler:
    num_cols: list[str]
    cat_cols: list[str]
    means: dict[str, float]
    stds: dict[str, float]
    weights: dict[int, list[float]]  # class -> component weights
    mus: dict[int, list[list[float]]]
    chols: dict[int, list[list[list[float]]]]
    cats: dict[int, JointCategories]  # class -> draw tables by component, written to the shared folder
    trace: list[tuple]

    def history(self, spark) -> DataFrame:
        """Per class, the fit's log-likelihood and iteration count."""
        return spark.createDataFrame(self.trace, "label int, k int, log_likelihood double, n_iter int")

    def sample(self, spark, n: int, target: str, target_class: int = TARGET_CLASS, seed: int = 42) -> DataFrame:
        """N rows of one class in raw units + target + synthetic flag."""
        w = self.weights[target_class]
        rows = spark.range(n).withColumnRenamed("id", "synthetic_id")
        comp = gumbel_choice(list(range(len(w))), w, seed, "component", F.col("synthetic_id"))
        rows = rows.withColumn("__comp", comp)
        d = len(self.num_cols)
        zs = [_normal_key(seed, "mixture", F.col("synthetic_id"), F.lit(j)) for j in range(d)]
        cols = []
        for i, c in enumerate(self.num_cols):
            mu = F.element_at(F.array(*[F.lit(float(m[i])) for m in self.mus[target_class]]), F.col("__comp") + 1)
            x = mu
            for j in range(i + 1):
                lij = F.element_at(F.array(*[F.lit(float(L[i][j])) for L in self.chols[target_class]]), F.col("__comp") + 1)
                x = x + lij * zs[j]
            cols.append((x * F.lit(float(self.stds[c])) + F.lit(float(self.means[c]))).alias(c))
        out = rows.select("synthetic_id", "__comp", *cols)
        if self.cat_cols:
            out = self.cats[target_class].draw(out, seed, "cat", "synthetic_id")
        return out.select("synthetic_id", *self.num_cols, *self.cat_cols, F.lit(target_class).alias(target), F.lit(True).alias(SYNTHETIC_FLAG))


def fit_mixture(train: DataFrame, target: str, num_cols: Sequence[str], cat_cols: Sequence[str] = (), k: int = 3, seed: int = 42, max_iter: int = 100, ridge: float = 1e-6) -> MixtureSampler:
    """Per class, a k-component Gaussian mixture on standardised numeric
    columns (zero-variance columns keep a tiny ridge) and joint category frequencies
    per hard-assigned component, along one dependency tree a class."""
    num_cols, cat_cols = list(num_cols), list(cat_cols)
    st = train.agg(*[F.avg(c).alias(f"m_{c}") for c in num_cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in num_cols]).first()
    means = {c: st[f"m_{c}"] or 0.0 for c in num_cols}
    stds = {c: (st[f"s_{c}"] or 1.0) or 1.0 for c in num_cols}
    z = train.select(
        target, *cat_cols, F.array(*[((F.col(c) - F.lit(means[c])) / F.lit(stds[c])).cast("double") for c in num_cols]).alias("__z")
    ).withColumn("features", array_to_vector("__z"))
    classes = [r[0] for r in train.select(target).distinct().collect()]
    weights, mus, chols, cats, trace = {}, {}, {}, {}, []
    for cls in sorted(classes):
        part = z.where(F.col(target) == cls)
        n_rows = part.count()
        kk = max(1, min(k, n_rows))
        gm = GaussianMixture(k=kk, seed=seed, maxIter=max_iter, featuresCol="features", probabilityCol="__prob", predictionCol="__comp")
        m = gm.fit(part)
        weights[cls] = [float(x) for x in m.weights]
        g = m.gaussians
        mus[cls] = [list(map(float, r.mean.toArray())) for r in g]
        ch = []
        for r in g:
            cov = np.array(r.cov.toArray(), dtype=float)
            cov = (cov + cov.T) / 2 + np.eye(cov.shape[0]) * ridge
            try:
                L = np.linalg.cholesky(cov)
            except np.linalg.LinAlgError:
                vals, vecs = np.linalg.eigh(cov)
                L = vecs @ np.diag(np.sqrt(np.clip(vals, ridge, None)))
            ch.append(L.tolist())
        chols[cls] = ch
        trace.append((int(cls), kk, float(m.summary.logLikelihood), int(m.summary.numIter)))
        if cat_cols:
            assigned = staged(m.transform(part).select("__comp", *cat_cols), "assigned")
            # a component that no row is assigned to draws from the whole class
            used = {r["__comp"] for r in assigned.select("__comp").distinct().collect()}
            rows = assigned.withColumn("__comp", F.explode(F.array(F.col("__comp"), *[F.lit(i) for i in range(kk) if i not in used]))) if len(used) < kk else assigned
            counts = category_counts(rows, cat_cols, ["__comp"])
            cats[cls] = fit_joint(counts, staged(pair_counts(rows, cat_cols, ["__comp"]), "pairs") if len(cat_cols) > 1 else counts, cat_cols, ["__comp"])
    return MixtureSampler(num_cols, cat_cols, means, stds, weights, mus, chols, cats, trace)


# ---------------------------------------------------------------- G9 / G10
def realism_score(
    real: DataFrame,
    synthetic: DataFrame,
    num_cols: Sequence[str],
    cat_cols: Sequence[str] = (),
    target: str | None = None,
    out: str = "realism",
    folds: int = 2,
    buckets: int = 1 << 12,
    seed: int = 42,
) -> DataFrame:
    """Classifier two-sample test. A logistic regression separates real (1)
    from synthetic (0) rows by numbers, hashed category indicators and, given ``target``, both crossed with the class; each
    row's margin is its realism score. The AUC of this score over the stack is the fidelity figure (0.5 = indistinguishable).

    Rows are dealt to ``folds`` by a hash of their values, equal rows together, and scored by the model of the other folds, so no
    row is scored by a model that saw it. A null number counts as the column's mean, a null category as one of its own. With rows of
    one origin only, margins are infinite or undefined: both tables must have rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    nums, cats = list(num_cols), list(cat_cols)
    own = [*nums, *cats, *([target] if target else [])]
    means = real.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in nums]).first().asDict() if nums else {}
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))) for c in nums}
    text = {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in cats}
    if target:
        cls = F.coalesce(F.col(target).cast("string"), F.lit("null"))
        # numbers given the class enter through the indicator of a fixed class: the first one in order
        first = real.select(cls.alias("c")).agg(F.min("c")).first()[0]
        x |= {f"__{c}_given": F.when(cls == F.lit(first), v).otherwise(0.0) for c, v in list(x.items())}
        text |= {f"__{c}_given": F.concat(cls, F.lit("|"), v) for c, v in list(text.items())} | {"__class": cls}
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("realism"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in own])), 1, 8), 16, 10)
    stack = stack_with_origin(real, synthetic, own).select(
        *own,
        "origin",
        (F.col("origin") == "real").cast("double").alias("__real"),
        F.pmod(place.cast("long"), F.lit(folds)).cast("int").alias("__fold"),
        F.array(*x.values()).cast("array<double>").alias("__x"),
        *[v.alias(f"__h{i}") for i, v in enumerate(text.values())],
    )
    stack = staged(stack, "stack").withColumn("__n", array_to_vector("__x"))
    inputs = ["__n"] if x else []
    if text:
        stack = FeatureHasher(inputCols=[f"__h{i}" for i in range(len(text))], outputCol="__h", numFeatures=buckets).transform(stack)
        inputs.append("__h")
    vec = VectorAssembler(inputCols=inputs, outputCol="__f").transform(stack)
    lr = LogisticRegression(featuresCol="__f", labelCol="__real", maxIter=50, standardization=True, regParam=1e-6)
    parts = [lr.fit(vec.where(F.col("__fold") != i)).transform(vec.where(F.col("__fold") == i)) for i in range(folds)]
    scored = [p.select(*own, "origin", vector_to_array("rawPrediction")[1].alias(out)) for p in parts]
    for p in scored[1:]:
        scored[0] = scored[0].unionByName(p)
    return scored[0]


def pca_projection(real: DataFrame, synthetic: DataFrame, num_cols: Sequence[str]) -> DataFrame:
    """Joint 2-component PCA of real and synthetic rows -> (origin, x, y); centred first."""
    stack = stack_with_origin(real, synthetic, list(num_cols))
    mu = stack.agg(*[F.avg(c).alias(c) for c in num_cols]).first().asDict()
    centred = stack.select("origin", *[(F.col(c) - F.lit(float(mu[c] or 0.0))).alias(c) for c in num_cols])
    vec = VectorAssembler(inputCols=list(num_cols), outputCol="__f").transform(centred)
    model = PCA(k=min(2, len(num_cols)), inputCol="__f", outputCol="__p").fit(vec)
    p = model.transform(vec).select("origin", vector_to_array("__p").alias("__a"))
    return p.select("origin", F.col("__a")[0].alias("x"), (F.col("__a")[1] if len(num_cols) > 1 else F.lit(0.0)).alias("y"))
