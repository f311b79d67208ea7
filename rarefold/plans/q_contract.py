"""Exact contracts of the queries that involve a fitted model.

What a fit returns cannot be written in SQL, but what it must keep can: one row per scored row, probabilities in
[0, 1] that agree with the label, sizes of training sets, values from the dictionary, distances that a rotation
keeps. Each query here runs the operator on whole tables and has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import experiment as E
from rarefold.operators import model as C
from rarefold.operators import synth as G
from rarefold.plans.flagship import flagship
from rarefold.plans.q_experiment import _scenarios, q_score_stream
from rarefold.plans.q_model import q_classifier_scores, q_gain_importance, q_score_new_data
from rarefold.plans.q_oversample import SQL_SM
from rarefold.plans.q_select import q_select_candidates
from rarefold.plans.q_synth import _POOL, _SHARES, CAT, NUM, SEED, _minority, _mixture, _pool, q_marginal_sample
from rarefold.plans.registry import register, rounded
from rarefold.functions.rng import sql_uniform

_TEST = """select o_orderkey, is_f from (select o_orderkey, cast(o_orderstatus = 'F' as integer) as is_f,
  row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders) where rn > floor(n * (0.7::double + 0.15::double))"""
_SCORED = f"select o_orderkey, true as in_range, true as label_agrees from ({_TEST})"


def _agreement(df):
    p = F.col(C.PROBA)
    return df.select("o_orderkey", ((p >= 0) & (p <= 1)).alias("in_range"), (F.col(C.PRED) == (p >= 0.5).cast("int")).alias("label_agrees"))


@register("classifier_scores_contract", _SCORED)
def q_scores_contract(spark, d):
    return _agreement(q_classifier_scores(spark, d))


@register("score_new_data_contract", _SCORED)
def q_new_data_contract(spark, d):
    return _agreement(q_score_new_data(spark, d))


@register("score_stream_contract", _SCORED)
def q_stream_contract(spark, d):
    return _agreement(q_score_stream(spark, d))


@register("flagship_contract", f"select count(*)::bigint as rows, sum(is_f)::bigint as positives, true as auc_in_range from ({_TEST})")
def q_flagship_contract(spark, d):
    m = flagship(spark, d)
    return m.select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        ((F.col("auc_roc") >= 0) & (F.col("auc_roc") <= 1) & (F.col("auc_pr") >= 0) & (F.col("auc_pr") <= 1)).alias("auc_in_range"),
    )


@register("gain_importance_contract", "select true as known, true as not_negative")
def q_gain_contract(spark, d):
    return q_gain_importance(spark, d).agg(
        F.bool_and(F.col("feature").isin("o_totalprice", "c_acctbal", "o_orderpriority", "c_nationkey", "c_mktsegment")).alias("known"),
        F.bool_and((F.col("gain") >= 0) & (F.col("n_splits") > 0)).alias("not_negative"),
    )


@register(
    "top_features_given",
    """with c as (select 'value' as feature, abs(value - 40) as a from events union all select 'user_id', abs(user_id % 17 - 8) from events
  union all select 'hour', abs(event_id % 24 - 12) from events)
select feature, round(avg(a), 6) as mean_abs_contribution from c group by feature order by 2 desc, 1 limit 2""",
)
def q_top_given(spark, d):
    from rarefold.plans.tables import table

    cells = [
        F.struct(F.lit("value").alias("feature"), (F.col("value") - 40).alias("contribution")),
        F.struct(F.lit("user_id").alias("feature"), (F.col("user_id") % 17 - 8).cast("double").alias("contribution")),
        F.struct(F.lit("hour").alias("feature"), (12 - F.col("event_id") % 24).cast("double").alias("contribution")),
    ]
    long = table(spark, d, "events").select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rounded(C.top_features(long, 2))


_TRAIN = f"""t as ({SQL_SM}), rr as (select *, row_number() over (order by event_id) as rn, count(*) over () as n from t),
tr as (select * from rr where rn <= floor(n * 0.7::double)), c as (select count(*)::bigint as n, sum(y)::bigint as p from tr)"""


@register("select_candidates_contract", f"with {_TRAIN} select unnest(range(floor(p * 1.0 * 3)::bigint)) as event_id, true as agrees from c")
def q_select_contract(spark, d):
    return q_select_candidates(spark, d).select("event_id", (F.col("keep") == (F.col("predicted_gain") > 0)).alias("agrees"))


@register(
    "scenario_sizes",
    f"""with {_TRAIN} select 'as_is' as scenario, n as n_train_samples, p as n_positive_train from c
union all select 'smote', 2 * (n - p), n - p from c
union all select 'all_synthetic', n + floor(p * 1.0 * 3)::bigint, p + floor(p * 1.0 * 3)::bigint from c""",
)
def q_scenario_sizes(spark, d):
    base, syn, pool, selected, _ = _scenarios(spark, d)
    sizes = E.scenario_table(base, syn, pool, selected).where(F.col("scenario") != E.SELECTED).groupBy("scenario")
    return sizes.agg(F.count(F.lit(1)).alias("n_train_samples"), F.count_if(F.col("y") == 1).alias("n_positive_train"))


@register(
    "mixture_sample_contract",
    f"""with n as (select {_POOL} as n from ({SQL_SM})) select unnest(range(n)) as synthetic_id, 1::integer as y, true as finite, true as known from n""",
)
def q_mixture_contract(spark, d):
    s = _mixture(spark, d).sample(spark, _pool(spark, d), "y", 1, SEED)
    finite = F.lit(True)
    for c in NUM:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    return s.select("synthetic_id", F.col("y").cast("int").alias("y"), finite.alias("finite"), F.col(CAT[0]).isin("0", "1", "2").alias("known"))


@register("mixture_trace_contract", f"select y as label, least(3, count(*))::integer as k, true as ran from ({SQL_SM}) group by y")
def q_trace_contract(spark, d):
    return _mixture(spark, d).history(spark).select("label", "k", (F.col("n_iter") > 0).alias("ran"))


@register(
    "projection_norms",
    f"""with {_SHARES},
rv as (select value, row_number() over (order by value, event_id) as r, count(*) over () as c from m),
ru as (select uid, row_number() over (order by uid, event_id) as r, count(*) over () as c from m),
s as (select rv.value, ru.uid from ids join rv on rv.r = floor({sql_uniform(SEED, 'marginal-value', 'ids.j')} * rv.c) + 1
      join ru on ru.r = floor({sql_uniform(SEED, 'marginal-uid', 'ids.j')} * ru.c) + 1),
a as (select 'real' as origin, value, uid from m union all select 'synthetic', value, uid from s),
mu as (select avg(value) as mv, avg(uid) as mq from a)
select origin, count(*)::bigint as n, round(sum((value - mv) * (value - mv) + (uid - mq) * (uid - mq)) / count(*), 4) as mean_square from a, mu group by origin""",
)
def q_projection_norms(spark, d):
    """A projection of two columns on two components is a rotation: squared distances from the mean stay."""
    p = G.pca_projection(_minority(spark, d), q_marginal_sample(spark, d), NUM)
    return p.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 4).alias("mean_square"))


@register(
    "time_split_string_id",
    """select 'k' || o_orderkey as id, case when rn <= floor(n * 0.7::double) then 'train' when rn <= floor(n * (0.7::double + 0.15::double)) then 'val' else 'test' end as split
from (select o_orderkey, row_number() over (order by o_orderdate, 'k' || o_orderkey) as rn, count(*) over () as n from orders)""",
)
def q_time_split_string(spark, d):
    from rarefold.operators.split import assign_time_split
    from rarefold.plans.tables import table

    o = table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderdate")
    return assign_time_split(o, "o_orderdate", 0.7, 0.15, tiebreak="id").select("id", "split")
