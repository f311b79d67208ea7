"""Registered synthesis queries (G1-G10) over the minority rows of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.functions.rng import sql_normal, sql_uniform, uniform
from rarefold.operators import metrics as M
from rarefold.operators import synth as G
from rarefold.plans.q_oversample import SQL_SM, smote_input
from rarefold.plans.registry import register, rounded
from rarefold.plans.tables import table

SEED = 42
NUM, CAT = ["value", "uid"], ["c2"]
_POOL = "floor(count(*) filter (where y = 1) * 1.0 * 3)::bigint"


def _minority(spark, d):
    return smote_input(spark, d).where(F.col("y") == 1)


def _pool(spark, d) -> int:
    return G.pool_size_frame(smote_input(spark, d), "y").first()["pool_size"]


@register("pool_size", f"select {_POOL} as pool_size from ({SQL_SM})")
def q_pool_size(spark, d):
    return G.pool_size_frame(smote_input(spark, d), "y")


@register(
    "latent_noise",
    f"""with n as (select {_POOL} as n from ({SQL_SM}))
select id, position, round({sql_normal(SEED, 'noise', 'id', 'position')}, 6) as z
from n, lateral (select unnest(range(n)) as id), lateral (select unnest(range({G.LATENT_DIM})) as position)""",
)
def q_latent_noise(spark, d):
    z = G.latent_noise(spark, _pool(spark, d), G.LATENT_DIM, SEED)
    return rounded(z.select("id", F.posexplode("noise").alias("position", "z")).withColumn("position", F.col("position").cast("long")))


_SHARES = f"""m as (select * from ({SQL_SM}) where y = 1),
sh as (select cast(c2 as varchar) as value, count(*) as k from m group by c2),
shi as (select value, sum(k) over (order by value) - k as lo, sum(k) over (order by value) as hi, sum(k) over () as total from sh),
n as (select {_POOL} as n from ({SQL_SM})),
ids as (select unnest(range(n)) as j from n),
gc as (select j, value as c2 from (select j, {sql_uniform(SEED, 'marginal-c2', 'j')} as u from ids) join shi on floor(u * total) >= lo and floor(u * total) < hi)"""


@register("categorical_draw", f"with {_SHARES} select j as synthetic_id, c2 from gc")
def q_categorical_draw(spark, d):
    table = G.draw_table(G.category_counts(_minority(spark, d), CAT))
    rows = spark.range(_pool(spark, d)).withColumnRenamed("id", "synthetic_id")
    return G.draw_categories(rows, table, "c2", uniform(SEED, "marginal-c2", "synthetic_id")).select("synthetic_id", "c2")


@register(
    "marginal_sample",
    f"""with {_SHARES},
rv as (select value, row_number() over (order by value, event_id) as r, count(*) over () as c from m),
ru as (select uid, row_number() over (order by uid, event_id) as r, count(*) over () as c from m)
select ids.j as synthetic_id, round(rv.value, 6) as value, round(ru.uid, 6) as uid, gc.c2
from ids
join rv on rv.r = floor({sql_uniform(SEED, 'marginal-value', 'ids.j')} * rv.c) + 1
join ru on ru.r = floor({sql_uniform(SEED, 'marginal-uid', 'ids.j')} * ru.c) + 1
join gc on gc.j = ids.j""",
)
def q_marginal_sample(spark, d):
    s = G.marginal_sample(_minority(spark, d), "event_id", NUM, CAT, _pool(spark, d), SEED)
    return rounded(s.select("synthetic_id", "value", "uid", "c2"))


def _mixture(spark, d):
    return G.fit_mixture(smote_input(spark, d), "y", NUM, CAT, k=3, seed=SEED)


@register("mixture_sample")
def q_mixture_sample(spark, d):
    return rounded(_mixture(spark, d).sample(spark, _pool(spark, d), "y", 1, SEED))


@register("mixture_trace")
def q_mixture_trace(spark, d):
    return rounded(_mixture(spark, d).history(spark))


@register("realism_score")
def q_realism(spark, d):
    syn = _mixture(spark, d).sample(spark, _pool(spark, d), "y", 1, SEED)
    sc = G.realism_score(_minority(spark, d), syn, NUM, CAT, "y").withColumn("is_real", (F.col("origin") == "real").cast("int"))
    return rounded(M.ranking_metrics(sc, "is_real", "realism", fpr_targets=()).select(F.col("auc_roc").alias("fidelity_auc")))


@register("pca_projection")
def q_pca(spark, d):
    syn = _mixture(spark, d).sample(spark, _pool(spark, d), "y", 1, SEED)
    return rounded(G.pca_projection(_minority(spark, d), syn, NUM))


# ---------------------------------------------------------------- joint categories of the order lines
LINE = ["returnflag", "linestatus", "linenumber", "ship_year"]
_LINES = """t as (select l_returnflag as returnflag, l_linestatus as linestatus, cast(l_linenumber as varchar) as linenumber,
  cast(year(l_shipdate) as varchar) as ship_year from lineitem)"""
_PAIRS = ", pc as (" + " union all ".join(
    f"select '{a}' as first_feature, {a} as first_value, '{b}' as second_feature, {b} as second_value, count(*) as n from t group by {a}, {b}"
    for i, a in enumerate(LINE)
    for b in LINE[i + 1 :]
) + ")"


def _lines(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("l_linenumber").cast("string").alias("linenumber"), F.year("l_shipdate").cast("string").alias("ship_year")
    )


@register("category_pair_counts", f"with {_LINES} {_PAIRS} select * from pc")
def q_pair_counts(spark, d):
    return G.pair_counts(_lines(spark, d), LINE)


# an edge is in the tree if no heavier edges join its ends
@register(
    "category_tree",
    f"""with recursive {_LINES} {_PAIRS},
a as (select first_feature, second_feature, first_value, sum(n)::double as na from pc group by all),
b as (select first_feature, second_feature, second_value, sum(n)::double as nb from pc group by all),
c as (select first_feature, second_feature, sum(n)::double as total from pc group by all),
mi as (select first_feature, second_feature, sum(n * ln(n::double * total / (na * nb))) / sum(n) as information
  from pc join a using (first_feature, second_feature, first_value) join b using (first_feature, second_feature, second_value) join c using (first_feature, second_feature)
  group by all),
pos(f, i) as (values {', '.join(f"('{c}', {i})" for i, c in enumerate(LINE))}),
e as (select mi.*, row_number() over (order by round(information, 9) desc, p.i, q.i) as rk from mi join pos p on p.f = first_feature join pos q on q.f = second_feature),
reach as (select rk, first_feature as node from e union
  select reach.rk, case when e.first_feature = reach.node then e.second_feature else e.first_feature end
  from reach join e on e.rk < reach.rk and (reach.node = e.first_feature or reach.node = e.second_feature))
select first_feature, second_feature, round(information, 6) as information, rk not in (select reach.rk from reach join e f on f.rk = reach.rk and f.second_feature = reach.node) as in_tree from e""",
)
def q_category_tree(spark, d):
    return rounded(G.information_tree(G.pair_counts(_lines(spark, d), LINE), LINE))


def _draw(name, group, value):
    return f"""{name} as (select {group} as g, {value} as value, sum(count(*)) over (partition by {group} order by {value}) - count(*) as lo,
  sum(count(*)) over (partition by {group} order by {value}) as hi, sum(count(*)) over (partition by {group}) as total from t group by {', '.join(dict.fromkeys(c for c in (group, value) if c != '1'))})"""


@register(
    "joint_category_draw",
    f"""with {_LINES}, {_draw('root', '1', 'returnflag')}, {_draw('child', 'returnflag', 'linestatus')},
ids as (select unnest(range((select count(*) from orders))) as j),
us as (select j, {sql_uniform(SEED, 'joint-returnflag', 'j')} as u, {sql_uniform(SEED, 'joint-linestatus', 'j')} as v from ids)
select j as synthetic_id, root.value as returnflag, child.value as linestatus from us
join root on floor(u * root.total) >= root.lo and floor(u * root.total) < root.hi
join child on child.g = root.value and floor(v * child.total) >= child.lo and floor(v * child.total) < child.hi""",
)
def q_joint_draw(spark, d):
    return G.joint_sample(_lines(spark, d), LINE[:2], table(spark, d, "orders").count(), SEED)
