"""Registered classifier queries (rows-only checks: they involve fitted models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import model as C
from rarefold.operators import split as S
from rarefold.operators.attribution import tree_contributions
from rarefold.operators.boost import train_main_classifier
from rarefold.operators.prep import Preparer
from rarefold.plans.flagship import ROLES, flagship, orders_with_customers
from rarefold.plans.q_prep import DIRTY_ROLES, dirty
from rarefold.plans.registry import register, rounded
from rarefold.session import scratch_path, staged


@register("flagship_metric_row")
def q_flagship(spark, d):
    return rounded(flagship(spark, d))


def _fitted(spark, d):
    lab = S.assign_time_split(orders_with_customers(spark, d), "o_orderdate", 0.7, 0.15, tiebreak="o_orderkey")
    train, val, test = S.split_frames(staged(lab, "split"))
    prep = Preparer(ROLES).fit(train)
    return prep, train, val, test


@register("classifier_scores")
def q_classifier_scores(spark, d):
    prep, train, val, test = _fitted(spark, d)
    tv, vv = (staged(prep.transform_for_classifier(x), "view") for x in (train, val))
    clf = train_main_classifier(tv, prep.features, ROLES.target, vv, categorical=prep.categorical)
    sv = prep.transform_for_classifier(test, passthrough=["o_orderkey"])
    return rounded(clf.predict(sv).select("o_orderkey", C.PROBA, C.PRED))


@register("score_new_data")
def q_score_new_data(spark, d):
    prep, train, _, test = _fitted(spark, d)
    clf = C.train_fast_classifier(prep.transform_for_classifier(train), prep.features, ROLES.target, dict(max_iter=10))
    return rounded(C.score_new_data(clf, prep, test.drop(ROLES.target)))


@register("gain_importance")
def q_gain_importance(spark, d):
    prep, train, _, _ = _fitted(spark, d)
    clf = C.train_fast_classifier(prep.transform_for_classifier(train), prep.features, ROLES.target, dict(max_iter=10))
    path = scratch_path(spark, "gbt")
    clf.save(path)
    imp = C.gain_importance(path)
    names = spark.createDataFrame(list(enumerate(prep.features)), "feature_index int, feature string")
    return rounded(imp.join(F.broadcast(names), "feature_index").select("feature", "gain", "n_splits"))


@register("top_features_linear")
def q_top_features_linear(spark, d):
    """Mean absolute contributions over all test rows, for the linear model."""
    lab = S.assign_time_split(dirty(spark, d), "ts", 0.7, 0.15, tiebreak="event_id")
    train, _, test = S.split_frames(staged(lab, "split"))
    prep = Preparer(DIRTY_ROLES).fit(train)
    tv = prep.transform_for_classifier(train)
    clf = C.train_linear(tv, prep.features, "y")
    means = tv.agg(*[F.avg(f).alias(f) for f in prep.features]).first().asDict()
    sv = prep.transform_for_classifier(test, passthrough=["event_id"])
    contrib = C.linear_contributions(clf, sv, means, "event_id")
    return rounded(C.top_features(contrib, 20))


@register("top_features_trees")
def q_top_features_trees(spark, d):
    """Mean absolute contributions over all test rows, for the boosted trees."""
    prep, train, _, test = _fitted(spark, d)
    clf = C.train_fast_classifier(prep.transform_for_classifier(train), prep.features, ROLES.target, dict(max_iter=10))
    long, _ = tree_contributions(clf, prep.transform_for_classifier(test, passthrough=["o_orderkey"]), "o_orderkey")
    return rounded(C.top_features(long, 20))


@register(
    "contributions_add_up",
    """select o_orderkey, true as adds_up from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders)
where rn > floor(n * (0.7::double + 0.15::double))""",
)
def q_contributions_add_up(spark, d):
    """Contributions and the base value give the margin of every scored row."""
    prep, train, _, test = _fitted(spark, d)
    clf = C.train_fast_classifier(prep.transform_for_classifier(train), prep.features, ROLES.target, dict(max_iter=10))
    view = prep.transform_for_classifier(test, passthrough=["o_orderkey"])
    long, base = tree_contributions(clf, view, "o_orderkey")
    total = long.groupBy("o_orderkey").agg(F.sum("contribution").alias("total"))
    p = clf.predict_proba(view).select("o_orderkey", C.PROBA)
    margin = F.lit(1.0) / (1 + F.exp(-2 * (F.col("total") + F.lit(base))))
    return total.join(p, "o_orderkey").select("o_orderkey", (F.abs(margin - F.col(C.PROBA)) < 1e-9).alias("adds_up"))
