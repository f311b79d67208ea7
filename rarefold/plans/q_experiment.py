"""Registered experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import experiment as E
from rarefold.operators import select as R
from rarefold.operators.boost import train_main_classifier
from rarefold.operators.model import train_fast_classifier
from rarefold.operators.oversample import smote
from rarefold.plans.q_metrics import _GROW_SQL, _grouped
from rarefold.plans.q_select import reward_metric, selection_splits
from rarefold.plans.registry import register, rounded
from rarefold.plans.tables import SQL_SCORED, scored_events
from rarefold.operators import metrics as M
from rarefold.session import scratch_path, staged

SEED, B = 42, 1000

_BOOT = f"""sc as ({SQL_SCORED}),
r as (select y, s, ('0x' || substr(md5('{SEED}|boot|' || cast(event_id as varchar)), 1, 12))::bigint % 2147483647 as h from sc),
x as (select b, y, s, {E.sql_weight('h', 'b')} as w from r, (select unnest(range({B})) as b)),
g as (select b, s, sum(y * w) as pos, sum(w) as cnt from x group by b, s),
c as (select b, s, pos, cnt, sum(pos) over w1 as cum_pos, sum(cnt) over w1 as cum_cnt, sum(pos) over (partition by b) as P, sum(cnt - pos) over (partition by b) as N
      from g window w1 as (partition by b order by s desc)),
m as (select b, sum(case when cum_cnt > 0 then pos * (cum_pos / cum_cnt) end) / max(P) as ap,
        coalesce(max(case when cum_cnt - cum_pos <= 0.05 * N then cum_pos end), 0) / max(P) as rec from c group by b)"""
_BOOT_SQL = f"with {_BOOT} select round(avg(ap), 6) as mean, round(quantile_cont(ap, 0.025), 6) as lower, round(quantile_cont(ap, 0.975), 6) as upper from m"


@register(
    "bootstrap_recall",
    f"with {_BOOT} select round(avg(rec), 6) as mean, round(quantile_cont(rec, 0.025), 6) as lower, round(quantile_cont(rec, 0.975), 6) as upper from m",
)
def q_bootstrap_recall(spark, d):
    return rounded(E.bootstrap_ci(scored_events(spark, d), "y", "s", "event_id", "recall_at_fpr_5e-02", B, 0.95, SEED))


@register("bootstrap_ci", _BOOT_SQL)
def q_bootstrap(spark, d):
    return rounded(E.bootstrap_ci(scored_events(spark, d), "y", "s", "event_id", "auc_pr", B, 0.95, SEED))


@register(
    "best_scenario",
    f"with g0 as ({_GROW_SQL}) select grp as scenario, auc_pr from g0 order by auc_pr desc, grp limit 1",
)
def q_best(spark, d):
    row = M.metric_row(_grouped(spark, d), "y", "s", 0.5, group_cols=["grp"]).select(F.col("grp").alias("scenario"), "auc_pr")
    return rounded(E.best_scenario(row))


def _scenarios(spark, d):
    return _scenario_parts(*selection_splits(spark, d))


def _scenario_parts(train, val, test, pool):
    feats = ["value", "uid", "c2"]
    syn = staged(smote(train, "y", "event_id", ["value", "uid"], ["c2"], 5, SEED).withColumn("y", F.lit(1)), "smote")  # every fit reads it
    rule, _ = R.fit_accept_rule(pool, "event_id", feats, reward_metric(train, val, feats), seed=SEED)
    selected = rule.select(pool).where("keep").select(*feats, "y")
    base = train.select(*feats, "y")
    return base, syn.select(*feats, "y"), pool.select(*feats, "y"), selected, feats


@register("ablation")
def q_ablation(spark, d):
    train, val, test, pool = selection_splits(spark, d)
    base, syn, pool, selected, feats = _scenario_parts(train, val, test, pool)
    table = E.scenario_table(base, syn, pool, selected)
    names = [r[0] for r in table.select("scenario").distinct().collect()]
    scen = {n: table.where(F.col("scenario") == n).drop("scenario") for n in sorted(names)}
    trainer = lambda rows: train_main_classifier(rows, feats, "y", val.select(*feats, "y"), categorical=["c2"])
    return rounded(E.run_ablation(scen, test.select(*feats, "y"), feats, "y", trainer))


@register("score_stream")
def q_score_stream(spark, d):
    from rarefold.operators.prep import Preparer
    from rarefold.plans.flagship import ROLES, orders_with_customers
    from rarefold.operators import split as S
    from rarefold.streaming.score import score_stream

    raw = orders_with_customers(spark, d)
    lab = S.assign_time_split(raw, "o_orderdate", 0.7, 0.15, tiebreak="o_orderkey")
    train, _, test = S.split_frames(staged(lab, "split"))
    prep = Preparer(ROLES).fit(train)
    clf = train_fast_classifier(prep.transform_for_classifier(train), prep.features, ROLES.target, dict(max_iter=10))
    src = scratch_path(spark, "feed")
    test.drop(ROLES.target).repartition(4).write.parquet(src)
    feed_schema = spark.read.parquet(src).schema
    out = score_stream(spark, clf, prep, src, feed_schema, scratch_path(spark, "scored"), scratch_path(spark, "ckpt"))
    return rounded(out)


@register("train_evaluate")
def q_train_evaluate(spark, d):
    """E7 -> E8 -> E6 on the transactions view, artifacts in the shared folder."""
    from rarefold.operators.prep import Roles
    from rarefold.plans.tables import LABEL, transactions
    from rarefold.plans.train import TrainConfig, rerun_ablation, run_evaluation, run_training

    cfg = TrainConfig(roles=Roles(target=LABEL, id="event_id", time="ts"))
    raw = transactions(spark, d)
    out = scratch_path(spark, "run")
    run_training(spark, raw, cfg, out)
    met = run_evaluation(spark, raw, cfg, out)
    abl = rerun_ablation(spark, raw, cfg, out)
    flat = met.select("auc_roc", "auc_pr", "f1", "mcc").withColumn("scenario", F.lit("final"))
    return rounded(flat.unionByName(abl.select("scenario", "auc_roc", "auc_pr", "f1", "mcc")))
