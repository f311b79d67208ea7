"""Registered selection queries (R1-R9, V8) over the minority rows of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.functions.rng import sql_uniform
from rarefold.operators import influence as I
from rarefold.operators import metrics as M
from rarefold.operators import select as R
from rarefold.operators import split as S
from rarefold.operators import validate as V
from rarefold.operators.model import PROBA, train_linear
from rarefold.operators.synth import marginal_sample, pool_size_frame
from rarefold.plans.q_oversample import smote_input
from rarefold.plans.registry import register, rounded
from rarefold.plans.tables import SQL_SCORED, scored_events
from rarefold.session import staged

SEED, EPS, SIZE = 42, R.EPISODES_PER_UPDATE, R.EPISODE_SIZE

_POOL = f"pool as (select event_id, y, s from ({SQL_SCORED}) where y = 1)"
_EPIS = f"""{_POOL},
pe as (select e as episode, event_id, {sql_uniform(SEED, 'episode', 'e', 'event_id')} as u from pool, range({EPS}) t(e)),
ep as (select episode, event_id, (row_number() over (partition by episode order by u, event_id) - 1)::integer as position from pe)"""
_KEEP = f"""kp as (select *, {sql_uniform(SEED, 'keep', 'episode', 'event_id')} < 0.5 as keep from ep where position < {SIZE})"""


def _pool(spark, d):
    return scored_events(spark, d).where("y = 1").select("event_id", "y", "s")


def _episodes(spark, d):
    return R.random_keep(R.draw_episodes(_pool(spark, d), "event_id", EPS, SIZE, SEED), "event_id", SEED)


@register("draw_episodes", f"with {_EPIS} select episode, event_id, position from ep where position < {SIZE}")
def q_draw_episodes(spark, d):
    return R.draw_episodes(_pool(spark, d), "event_id", EPS, SIZE, SEED)


@register(
    "running_state",
    f"""with {_EPIS}, {_KEEP}
select episode, event_id, position, keep,
  round(position / count(*) over (partition by episode), 6) as progress,
  round(coalesce(avg(keep::double) over (partition by episode order by position rows between unbounded preceding and 1 preceding), 0), 6) as ratio
from kp""",
)
def q_running_state(spark, d):
    return rounded(R.running_state(_episodes(spark, d)).select("episode", "event_id", "position", "keep", "progress", "ratio"))


@register("kept_rows", f"with {_EPIS}, {_KEEP} select episode, event_id from kp where keep")
def q_kept_rows(spark, d):
    return V.kept_rows(_episodes(spark, d)).select("episode", "event_id")


def _ap_sql(src: str, grp: str) -> str:
    return f"""(select {grp}, sum(pos * (cum_pos / cum_cnt)) / sum(pos) as ap from (
  select {grp}, pos, sum(pos) over (partition by {grp} order by s desc) as cum_pos, sum(cnt) over (partition by {grp} order by s desc) as cum_cnt
  from (select {grp}, s, sum(y) as pos, count(*) as cnt from {src} group by {grp}, s)) group by {grp})"""


_SUMMARY_SQL = f"""with sc as ({SQL_SCORED}), {_EPIS}, {_KEEP},
base as (select 0 as g, y, s from sc),
bl as (select ap as baseline from {_ap_sql('base', 'g')}),
aug as (select e as episode, y, s from sc, range({EPS}) t(e)
        union all select kp.episode, pool.y, pool.s from kp join pool using (event_id) where keep),
raw as {_ap_sql('aug', 'episode')},
cnt as (select episode, count(*) filter (where keep)::bigint as n_selected, count(*)::bigint as n_candidates from kp group by episode)
select cnt.episode, n_selected, n_candidates,
  round(case when n_selected = 0 then baseline else ap end, 6) as raw_score, round(baseline, 6) as baseline_score,
  round(case when n_selected = 0 then 0 else (ap - baseline) / greatest(abs(baseline), 1e-6) end, 6) as reward
from cnt join raw using (episode), bl"""


@register("episode_summary", _SUMMARY_SQL)
def q_episode_summary(spark, d):
    sc = scored_events(spark, d).select("y", "s")
    pool = _pool(spark, d)
    eps = _episodes(spark, d)
    baseline = M.ranking_metrics(sc, "y", "s", fpr_targets=()).first()["auc_pr"]
    kept = eps.where("keep").join(pool, "event_id").select("episode", "y", "s")
    # base rows once per episode (a generator, not a join), plus each episode's kept rows
    base = sc.select(F.explode(F.array(*[F.lit(e) for e in range(EPS)])).alias("episode"), "y", "s")
    raw = M.ranking_metrics(base.unionByName(kept), "y", "s", ["episode"], fpr_targets=()).select(
        F.col("episode").cast("int").alias("episode"), F.col("auc_pr").alias("raw_score")
    )
    return rounded(R.episode_summary(eps, raw, baseline))


@register("reward_formula", _SUMMARY_SQL.replace("select cnt.episode, n_selected, n_candidates,", "select cnt.episode,").replace("round(baseline, 6) as baseline_score,\n", ""))
def q_reward_formula(spark, d):
    return q_episode_summary(spark, d).select("episode", "raw_score", "reward")


def selection_splits(spark, d):
    """The training part, validation part, test part and candidates. Each is written once: every reward is a fit that reads them several times."""
    lab = S.assign_time_split(smote_input(spark, d), "event_id", 0.7, 0.15)
    train, val, test = S.split_frames(staged(lab, "split"))
    minority = train.where("y = 1")
    n = pool_size_frame(train, "y").first()["pool_size"]
    pool = marginal_sample(minority, "event_id", ["value", "uid"], ["c2"], n, SEED).withColumn("c2", F.col("c2").cast("int")).withColumn("y", F.lit(1))
    return train, val, test, staged(pool.withColumnRenamed("synthetic_id", "event_id"), "pool")


def selection_inputs(spark, d):
    train, val, _, pool = selection_splits(spark, d)
    return train, val, pool


def reward_metric(train, val, features, target="y"):
    """R4 with the cheap classifier: weighted logistic regression, AUC-PR on validation."""

    def metric_of(kept):
        rows = train.select(*features, target)
        if kept is not None:
            rows = rows.unionByName(kept.select(*features, target))
        clf = train_linear(rows, features, target)
        sc = clf.predict_proba(val.select(*features, target))
        return M.ranking_metrics(sc, target, PROBA, fpr_targets=()).first()["auc_pr"]

    return metric_of


@register("select_candidates")
def q_select_candidates(spark, d):
    train, val, pool = selection_inputs(spark, d)
    feats = ["value", "uid", "c2"]
    rule, _ = R.fit_accept_rule(pool, "event_id", feats, reward_metric(train, val, feats), EPS, SIZE, SEED)
    return rounded(rule.select(pool).select("event_id", "predicted_gain", "keep"))


def _influence(spark, d):
    train, val, pool = selection_inputs(spark, d)
    feats = ["value", "uid", "c2"]
    train, val = (staged(t.select(*feats, "y"), "influence") for t in (train, val))
    return I.fit_influence_rule(train, val, feats, "y"), train, pool


@register("influence_candidates")
def q_influence_candidates(spark, d):
    """Every candidate of the pool with what it is expected to take off the validation loss."""
    rule, _, pool = _influence(spark, d)
    return rule.select(pool).select("event_id", F.round("predicted_gain", 9).alias("predicted_gain"), "keep")


@register("influence_optimum", "select unnest(['(intercept)', 'value', 'uid', 'c2']) as feature, true as at_optimum")
def q_influence_optimum(spark, d):
    """The training loss has no slope left at the fitted coefficients: counted over the whole training part, apart from the fit."""
    rule, train, _ = _influence(spark, d)
    return I.stationarity(rule, train, "y").select("feature", (F.abs("gradient") < 1e-7).alias("at_optimum"))
