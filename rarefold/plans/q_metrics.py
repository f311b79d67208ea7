"""Registered metric queries (I1-I14) over the scored ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import metrics as M
from rarefold.plans.registry import register, rounded
from rarefold.plans.tables import SQL_SCORED, scored_events, table

FPR = (1e-4, 1e-3, 1e-2, 1e-1)

_SC = f"sc as ({SQL_SCORED})"
_CURVE = """
g as (select s, sum(y) as pos, count(*) as cnt from sc group by s),
c as (select s, pos, cnt, cnt - pos as neg,
             sum(pos) over (order by s desc) as cum_pos,
             sum(cnt) over (order by s desc) as cum_cnt from g),
t as (select cast(sum(pos) as double) as P, cast(sum(cnt - pos) as double) as N from g)
"""
_RANK = "sum(neg * (cum_pos - pos + pos / 2.0)) / (P * N) as auc_roc, sum(pos * (cum_pos / cum_cnt)) / P as auc_pr"


def _fpr_sql(t: float) -> str:
    return f'coalesce(max(case when cum_cnt - cum_pos <= {t!r} * N then cum_pos end), 0) / P as "{M.fpr_key(t)}"'


_CM = """
cm as (select count(*) filter (where y = 0 and s < 0.5)::bigint as tn,
              count(*) filter (where y = 0 and s >= 0.5)::bigint as fp,
              count(*) filter (where y = 1 and s < 0.5)::bigint as fn,
              count(*) filter (where y = 1 and s >= 0.5)::bigint as tp from sc)
"""
_PRF = """
coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as precision,
coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall,
coalesce(2 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0) as f1,
coalesce((cast(tp as double) * tn - cast(fp as double) * fn)
         / nullif(sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) as mcc
"""


@register(
    "confusion_matrix",
    f"with {_SC}, {_CM} select tn, fp, fn, tp from cm",
)
def q_confusion_matrix(spark, d):
    return M.confusion_counts(scored_events(spark, d), "y", "s", 0.5)


@register("roc_auc", f"with {_SC}, {_CURVE} select round(sum(neg * (cum_pos - pos + pos / 2.0)) / (P * N), 6) as auc_roc from c, t group by P, N")
def q_roc_auc(spark, d):
    return rounded(M.ranking_metrics(scored_events(spark, d), "y", "s").select("auc_roc"))


@register("average_precision", f"with {_SC}, {_CURVE} select round(sum(pos * (cum_pos / cum_cnt)) / P, 6) as auc_pr from c, t group by P")
def q_average_precision(spark, d):
    return rounded(M.ranking_metrics(scored_events(spark, d), "y", "s").select("auc_pr"))


@register(
    "prf",
    f"with {_SC}, {_CM}, m as (select {_PRF} from cm) select round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from m",
)
def q_prf(spark, d):
    return rounded(M.threshold_metrics(scored_events(spark, d), "y", "s", 0.5).select("precision", "recall", "f1"))


@register("mcc", f"with {_SC}, {_CM}, m as (select {_PRF} from cm) select round(mcc, 6) as mcc from m")
def q_mcc(spark, d):
    return rounded(M.threshold_metrics(scored_events(spark, d), "y", "s", 0.5).select("mcc"))


_FPR_SEL = ", ".join(_fpr_sql(t) for t in FPR)
_FPR_ROUND = ", ".join(f'round("{M.fpr_key(t)}", 6) as "{M.fpr_key(t)}"' for t in FPR)


@register("recall_at_fpr", f"with {_SC}, {_CURVE}, r as (select {_FPR_SEL} from c, t group by P, N) select {_FPR_ROUND} from r")
def q_recall_at_fpr(spark, d):
    r = M.ranking_metrics(scored_events(spark, d), "y", "s", fpr_targets=FPR)
    return rounded(r.select(*[F.col(f"`{M.fpr_key(t)}`") for t in FPR]))


_ROW_SQL = f"""
with {_SC}, {_CURVE}, {_CM},
r as (select {_RANK}, {_FPR_SEL} from c, t group by P, N),
m as (select tn, fp, fn, tp, {_PRF} from cm)
select round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr, round(f1, 6) as f1,
       round(precision, 6) as precision, round(recall, 6) as recall, round(mcc, 6) as mcc,
       tn, fp, fn, tp, {_FPR_ROUND}
from r, m
"""


_NULL_SQL = _ROW_SQL.replace(_SC, f"sc as (select y, case when event_id % 9 = 0 then -1 else s end as s from ({SQL_SCORED}))", 1)


@register("metric_row_null_scores", _NULL_SQL)
def q_metric_row_null_scores(spark, d):
    """Every ninth score is missing and ranks below all others."""
    s = scored_events(spark, d).withColumn("s", F.when(F.col("event_id") % 9 != 0, F.col("s")))
    return rounded(M.metric_row(s, "y", "s", 0.5, FPR, flat=True, nulls="lowest"))


@register("metric_row", _ROW_SQL)
def q_metric_row(spark, d):
    return rounded(M.metric_row(scored_events(spark, d), "y", "s", 0.5, FPR, flat=True))


_GSC = f"gsc as (select user_id % 5 as grp, y, s from ({SQL_SCORED}))"
_GCURVE = """
g as (select grp, s, sum(y) as pos, count(*) as cnt from gsc group by grp, s),
c as (select grp, s, pos, cnt, cnt - pos as neg,
             sum(pos) over (partition by grp order by s desc) as cum_pos,
             sum(cnt) over (partition by grp order by s desc) as cum_cnt from g),
t as (select grp, cast(sum(pos) as double) as P, cast(sum(cnt - pos) as double) as N from g group by grp)
"""
_GCM = """
cm as (select grp, count(*) filter (where y = 0 and s < 0.5)::bigint as tn,
              count(*) filter (where y = 0 and s >= 0.5)::bigint as fp,
              count(*) filter (where y = 1 and s < 0.5)::bigint as fn,
              count(*) filter (where y = 1 and s >= 0.5)::bigint as tp from gsc group by grp)
"""
_GROW_SQL = f"""
with {_GSC}, {_GCURVE}, {_GCM},
r as (select c.grp, {_RANK}, {_FPR_SEL} from c join t using (grp) group by c.grp, P, N),
m as (select grp, tn, fp, fn, tp, {_PRF} from cm)
select r.grp, round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr, round(f1, 6) as f1,
       round(precision, 6) as precision, round(recall, 6) as recall, round(mcc, 6) as mcc,
       tn, fp, fn, tp, {_FPR_ROUND}
from r join m using (grp)
"""


def _grouped(spark, d):
    return scored_events(spark, d).withColumn("grp", F.col("user_id") % 5)


@register("metric_row_by_group", _GROW_SQL)
def q_metric_row_by_group(spark, d):
    return rounded(M.metric_row(_grouped(spark, d), "y", "s", 0.5, FPR, group_cols=["grp"], flat=True))


_REPORT_LINES = (
    ["'=== Evaluation: ' || 'grp_' || grp || ' ==='"]
    + [f"printf('  %12s: %.4f', '{k}', {k})" for k in M.REPORT_KEYS]
    + [f"printf('  %20s: %.4f', '{M.fpr_key(t)}', \"{M.fpr_key(t)}\")" for t in M.DEFAULT_FPR_TARGETS]
    + ["printf('  confusion_matrix : TP=%d FP=%d FN=%d TN=%d', tp, fp, fn, tn)"]
)
_REPORT_SQL = f"""
with {_GSC}, {_GCURVE}, {_GCM},
r as (select c.grp, {_RANK}, {", ".join(_fpr_sql(t) for t in M.DEFAULT_FPR_TARGETS)} from c join t using (grp) group by c.grp, P, N),
m as (select grp, tn, fp, fn, tp, {_PRF} from cm)
select r.grp, concat_ws(chr(10), {", ".join(_REPORT_LINES)}) as report
from r join m using (grp)
"""


@register("metrics_report", _REPORT_SQL)
def q_metrics_report(spark, d):
    row = M.metric_row(_grouped(spark, d), "y", "s", 0.5, group_cols=["grp"])
    rep = M.metrics_report(row, F.concat(F.lit("grp_"), F.col("grp").cast("string")))
    return rep.select("grp", "report")


@register(
    "pr_curve",
    f"""with {_SC}, {_CURVE}
select round(s, 6) as threshold, round(cum_pos / cast(cum_cnt as double), 6) as precision,
       round(cum_pos / P, 6) as recall from c, t
union all select null, 1.0, 0.0""",
)
def q_pr_curve(spark, d):
    return rounded(M.pr_curve(scored_events(spark, d), "y", "s"))


_ROC_POINTS = """
pts as (select s as threshold, cum_cnt - cum_pos as cum_neg, cum_pos from c
        union all select 'inf'::double, 0, 0),
roc as (select threshold, cum_neg / N as fpr, cum_pos / P as tpr,
               cum_neg, cum_pos,
               lag(cum_neg) over (order by threshold desc) as pn, lead(cum_neg) over (order by threshold desc) as nn,
               lag(cum_pos) over (order by threshold desc) as pp, lead(cum_pos) over (order by threshold desc) as np
        from pts, t)
"""


@register(
    "roc_curve",
    f"with {_SC}, {_CURVE}, {_ROC_POINTS} select round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from roc",
)
def q_roc_curve(spark, d):
    return rounded(M.roc_curve(scored_events(spark, d), "y", "s"))


@register(
    "roc_curve_dropped",
    f"""with {_SC}, {_CURVE}, {_ROC_POINTS}
select round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from roc
where pn is null or nn is null or nn - 2 * cum_neg + pn <> 0 or np - 2 * cum_pos + pp <> 0""",
)
def q_roc_curve_dropped(spark, d):
    return rounded(M.roc_curve(scored_events(spark, d), "y", "s", drop_intermediate=True))


@register(
    "confusion_grid",
    f"""with {_GSC}, {_GCM}
select grp, actual, predicted, count from cm,
  (values (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted),
  lateral (select case when actual = 0 and predicted = 0 then tn when actual = 0 then fp
                       when predicted = 0 then fn else tp end::bigint as count)""",
)
def q_confusion_grid(spark, d):
    cm = M.confusion_counts(_grouped(spark, d), "y", "s", 0.5, ["grp"])
    return M.confusion_grid(cm, ["grp"])


@register(
    "moving_average",
    """select event_id, row_number() over (order by ts, event_id) as position,
       case when row_number() over (order by ts, event_id) >= 20
            then round(avg(value) over (order by ts, event_id rows between 19 preceding and current row), 6) end as moving_avg
from events""",
)
def q_moving_average(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", "value")
    r = M.moving_average(ev, "ts", "value", 20, tiebreak="event_id")
    return rounded(r.select("event_id", "position", "moving_avg"))


@register(
    "metric_unpivot",
    f"""with {_GSC}, {_GCURVE}, {_GCM},
r as (select c.grp, {_RANK} from c join t using (grp) group by c.grp, P, N),
m as (select grp, {_PRF} from cm),
w as (select r.grp, auc_pr, auc_roc, f1, recall from r join m using (grp))
select grp, metric, round(value, 6) as value from w
unpivot (value for metric in (auc_pr, auc_roc, f1, recall))""",
)
def q_metric_unpivot(spark, d):
    row = M.metric_row(_grouped(spark, d), "y", "s", 0.5, group_cols=["grp"])
    return rounded(M.metric_unpivot(row, ["grp"]))
