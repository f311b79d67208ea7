"""Registered oversampling queries (O1-O4, J2, E1 counts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.functions.rng import sql_uniform
from rarefold.operators import oversample as O
from rarefold.plans.registry import register, rounded
from rarefold.plans.tables import table

SEED, K = 42, 5


@register(
    "knn_minority",
    f"""with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
p as (select a.label, a.vec_id, b.vec_id as neighbor_id, list_distance(a.v, b.v) as d
      from e a join e b on a.label = b.label and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by vec_id order by d, neighbor_id) as rank from p)
select label, vec_id, rank, neighbor_id, round(d, 6) as distance from r where rank <= {K}""",
)
def q_knn_minority(spark, d):
    emb = table(spark, d, "embeddings")
    nn = O.knn_within(emb, "vec_id", vector_col="embedding", k=K, group_cols=["label"])
    return rounded(nn.withColumn("rank", F.col("rank").cast("long")))


SQL_SM = """select event_id, value, cast(user_id as double) as uid, cast(user_id % 3 as integer) as c2,
  cast(event_type = 'purchase' and value > 100 as integer) as y from events"""


def smote_input(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        "value",
        F.col("user_id").cast("double").alias("uid"),
        (F.col("user_id") % 3).cast("int").alias("c2"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int").alias("y"),
    )


def _smote_sql(with_cat: bool) -> str:
    pen = "+ case when a.c2 <> b.c2 then pen2 else 0 end" if with_cat else ""
    cat_sel = ", md.c2" if with_cat else ""
    cat_join = "join md on md.aid = b.event_id" if with_cat else ""
    return f"""with t as ({SQL_SM}), m as (select * from t where y = 1),
cnt as (select count(*) filter (where y = 1) as pos, count(*) filter (where y <> 1) as neg from t),
sd as (select ((stddev_pop(value) + stddev_pop(uid)) / 2) * ((stddev_pop(value) + stddev_pop(uid)) / 2) as pen2 from m),
nn as (select aid, bid, rank from (
  select a.event_id as aid, b.event_id as bid,
         row_number() over (partition by a.event_id order by sqrt((a.value - b.value) * (a.value - b.value) + (a.uid - b.uid) * (a.uid - b.uid) {pen}), b.event_id) as rank
  from m a join m b on a.event_id <> b.event_id, sd) where rank <= {K}),
md as (select aid, c2 from (select nn.aid, x.c2, row_number() over (partition by nn.aid order by count(*) desc, x.c2) as r
       from nn join m x on x.event_id = nn.bid group by nn.aid, x.c2) where r = 1),
mr as (select *, row_number() over (order by event_id) - 1 as rn from m),
gen as (select j, floor({sql_uniform(SEED, 'smote-base', 'j')} * pos)::bigint as rn,
               (1 + floor({sql_uniform(SEED, 'smote-nb', 'j')} * {K}))::integer as rank,
               {sql_uniform(SEED, 'smote-step', 'j')} as lam
        from cnt, (select unnest(range(neg - pos)) as j from cnt))
select j as synthetic_id, round(b.value + lam * (n.value - b.value), 6) as value, round(b.uid + lam * (n.uid - b.uid), 6) as uid {cat_sel}
from gen join mr b on b.rn = gen.rn join nn on nn.aid = b.event_id and nn.rank = gen.rank join m n on n.event_id = nn.bid {cat_join}"""


@register("smote", _smote_sql(False))
def q_smote(spark, d):
    return rounded(O.smote(smote_input(spark, d), "y", "event_id", ["value", "uid"], k=K, seed=SEED))


@register("smotenc", _smote_sql(True))
def q_smotenc(spark, d):
    return rounded(O.smote(smote_input(spark, d), "y", "event_id", ["value", "uid"], ["c2"], k=K, seed=SEED))


@register(
    "augment_counts",
    f"""with t as ({SQL_SM}), cnt as (select count(*) filter (where y = 1) as pos, count(*) filter (where y <> 1) as neg from t)
select y, false as {O.SYNTHETIC_FLAG}, count(*)::bigint as n from t group by y
union all select 1, true, (neg - pos)::bigint from cnt""",
)
def q_augment_counts(spark, d):
    r = O.smote_resample(smote_input(spark, d), "y", "event_id", ["value", "uid"], ["c2"], k=K, seed=SEED)
    return r.groupBy("y", O.SYNTHETIC_FLAG).agg(F.count(F.lit(1)).cast("long").alias("n"))
