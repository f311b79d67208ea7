"""Registered queries: load/join, validation, split, preparation, weighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.functions.rng import sql_uniform
from rarefold.operators import split as S
from rarefold.operators import validate as V
from rarefold.operators.join import left_join
from rarefold.operators.prep import Preparer, Roles, infer_kinds
from rarefold.operators.weight import pos_weight_frame
from rarefold.plans.registry import register, rounded
from rarefold.plans.tables import LABEL, SQL_TX, table, transactions
from rarefold.session import staged

SEED = 42
TRAIN, VAL = 0.7, 0.15

# ---------------------------------------------------------------- dirty events
# missing values are injected by expression, identically on both sides
SQL_DIRTY = """select event_id, ts,
  case when event_id % 7 = 0 then null else value end as n1,
  case when event_id % 13 = 0 then 'nan'::double else cast(user_id as double) end as n2,
  cast(null as double) as n_null,
  1.0::double as n_const,
  case when event_id % 5 = 0 then null else event_type end as c1,
  cast(user_id % 3 as integer) as c2,
  cast(event_type = 'purchase' and value > 100 as integer) as y
from events"""


def dirty(spark, d):
    e = table(spark, d, "events")
    eid = F.col("event_id")
    return e.select(
        "event_id",
        "ts",
        F.when(eid % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("n1"),
        F.when(eid % 13 == 0, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double")).alias("n2"),
        F.lit(None).cast("double").alias("n_null"),
        F.lit(1.0).alias("n_const"),
        F.when(eid % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("c1"),
        (F.col("user_id") % 3).cast("int").alias("c2"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int").alias("y"),
    )


DIRTY_ROLES = Roles(target="y", id="event_id", time="ts")

# ---------------------------------------------------------------- join
# every fifth customer key is turned into one that no customer has, on both sides of the check
_SQL_OC = """select case when o.o_custkey % 5 = 0 then -o.o_custkey else o.o_custkey end as custkey, o.o_orderkey, o.o_orderstatus, round(o.o_totalprice, 6) as o_totalprice,
  o.o_orderpriority, c.c_name, c.c_nationkey, round(c.c_acctbal, 6) as c_acctbal, c.c_mktsegment
from orders o left join customer c
  on case when o.o_custkey % 5 = 0 then -o.o_custkey else o.o_custkey end = c.c_custkey"""


def orders_customers(spark, d):
    key = F.when(F.col("o_custkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    o = table(spark, d, "orders").select(
        key.alias("custkey"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    return left_join(o, c, "custkey")


@register("left_join", _SQL_OC)
def q_left_join(spark, d):
    return rounded(orders_customers(spark, d))


# ---------------------------------------------------------------- split
_SQL_TIME = f"""r as (select event_id, row_number() over (order by ts, event_id) as rn, count(*) over () as n from events),
ts as (select event_id, case when rn <= floor(n * {TRAIN!r}::double) then 'train'
                           when rn <= floor(n * ({TRAIN!r}::double + {VAL!r}::double)) then 'val' else 'test' end as split from r)"""


def _time_split(spark, d):
    return S.assign_time_split(transactions(spark, d), "ts", TRAIN, VAL, tiebreak="event_id")


@register("time_split_rows", f"with {_SQL_TIME} select event_id, split from ts")
def q_time_split_rows(spark, d):
    return _time_split(spark, d).select("event_id", "split")


@register("time_split_counts", f"with {_SQL_TIME} select split, count(*)::bigint as n from ts group by split")
def q_time_split_counts(spark, d):
    return _time_split(spark, d).groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register(
    "time_split_orders",
    f"""with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders)
select o_orderkey, case when rn <= floor(n * {TRAIN!r}::double) then 'train'
  when rn <= floor(n * ({TRAIN!r}::double + {VAL!r}::double)) then 'val' else 'test' end as split from r""",
)
def q_time_split_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return S.assign_time_split(o, "o_orderdate", TRAIN, VAL, tiebreak="o_orderkey").select("o_orderkey", "split")


_REM = 0.15 / (0.15 + 0.15)
_SQL_STRAT = f"""b as (select event_id, is_fraud as y, {sql_uniform(SEED, 'split', 'event_id')} as u from ({SQL_TX})),
r as (select event_id, y, row_number() over (partition by y order by u, event_id) as rn, count(*) over (partition by y) as n from b),
ss as (select event_id, y, case when rn <= floor(n * {TRAIN!r}::double) then 'train'
        when rn <= floor(n * {TRAIN!r}::double) + floor((n - floor(n * {TRAIN!r}::double)) * {_REM!r}::double) then 'val'
        else 'test' end as split from r)"""


def _strat(spark, d):
    return S.assign_random_split(transactions(spark, d), LABEL, "event_id", TRAIN, VAL, 0.15, seed=SEED)


@register("stratified_split_rows", f"with {_SQL_STRAT} select event_id, split from ss")
def q_strat_rows(spark, d):
    return _strat(spark, d).select("event_id", "split")


@register("stratified_split_counts", f"with {_SQL_STRAT} select split, y as {LABEL}, count(*)::bigint as n from ss group by split, y")
def q_strat_counts(spark, d):
    return _strat(spark, d).groupBy("split", LABEL).agg(F.count(F.lit(1)).cast("long").alias("n"))


@register(
    "class_counts",
    "select count(*) filter (where o_orderstatus <> 'F')::bigint as negative, count(*) filter (where o_orderstatus = 'F')::bigint as positive from orders",
)
def q_class_counts(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return S.class_counts(o, "y")


# ---------------------------------------------------------------- validation (V2-V5, V7)
_DIRTY_COLS = [("event_id", "int"), ("ts", "ts"), ("n1", "dbl"), ("n2", "dbl"), ("n_null", "dbl"), ("n_const", "dbl"), ("c1", "str"), ("c2", "int"), ("y", "int")]


def _present(c, k):
    return f"count(case when not isnan({c}) then 1 end)" if k == "dbl" else f"count({c})"


@register(
    "all_null_columns",
    f"with d as ({SQL_DIRTY}) select feature from ("
    + " union all ".join(f"select '{c}' as feature, {_present(c, k)} as n from d" for c, k in _DIRTY_COLS)
    + ") where n = 0",
)
def q_all_null(spark, d):
    return V.all_null_columns(dirty(spark, d))


@register("binary_target", f"with d as ({SQL_DIRTY}) select distinct y as label from d where y is not null")
def q_binary_target(spark, d):
    return V.label_values(V.check_binary_target(dirty(spark, d), "y"), "y")


_SQL_INF = f"""with d as (select *, case when event_id % 11 = 0 then 'inf'::double when event_id % 17 = 0 then '-inf'::double else n1 end as n_inf from ({SQL_DIRTY}))
select feature from ({" union all ".join(f"select '{c}' as feature, count(*) filter (where abs({c}) = 'inf'::double) as n from d" for c in ("n1", "n2", "n_null", "n_const", "n_inf"))}) where n > 0"""


@register("nonfinite_columns", _SQL_INF)
def q_nonfinite(spark, d):
    eid = F.col("event_id")
    df = dirty(spark, d).withColumn(
        "n_inf", F.when(eid % 11 == 0, F.lit(float("inf"))).when(eid % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("n1"))
    )
    return V.nonfinite_columns(df, ["n1", "n2", "n_null", "n_const", "n_inf", "not_a_column"])


@register("class_balance", f"with d as ({SQL_DIRTY}) select count(*) filter (where y = 1)::bigint as n_positive from d")
def q_class_balance(spark, d):
    df = V.check_class_balance(dirty(spark, d), "y", 10)
    return V.positive_count(df, "y")


@register("minority_rows", f"select event_id, round(value, 6) as value, user_id from ({SQL_TX}) where is_fraud = 1")
def q_minority(spark, d):
    return rounded(V.minority_rows(transactions(spark, d), LABEL, ["event_id", "value", "user_id"]))


# ---------------------------------------------------------------- kinds (F1, F2)
_LI = [("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True), ("l_quantity", True), ("l_extendedprice", True),
       ("l_discount", True), ("l_tax", True), ("l_returnflag", False), ("l_linestatus", False)]
_LI_ROLES = Roles(target="l_returnflag", time="l_shipdate", drop=("l_orderkey",))


def _kinds_sql(cols, source, low=20):
    parts = []
    for i, (c, num) in enumerate(cols):
        kind = f"case when count(distinct {c}) = 0 then 'dropped' when count(distinct {c}) > {low} then 'numeric' else 'categorical' end" if num else \
            f"case when count(distinct {c}) = 0 then 'dropped' else 'categorical' end"
        parts.append(f"select {i} as ord, '{c}' as feature, {kind} as kind from {source}")
    return (
        f"select feature, kind, (row_number() over (partition by kind order by ord) - 1)::integer as position from ({' union all '.join(parts)})"
    )


@register("infer_kinds", _kinds_sql([c for c in _LI if c[0] != "l_returnflag"], "lineitem"))
def q_infer_kinds(spark, d):
    li = table(spark, d, "lineitem")
    return infer_kinds(li, _LI_ROLES).select("feature", "kind", "position")


_OC_STR = ["o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment"]


@register(
    "high_cardinality",
    f"with oc as ({_SQL_OC}) select feature from ("
    + " union all ".join(f"select '{c}' as feature, count(distinct {c}) as n from oc" for c in _OC_STR if c != "o_orderstatus")
    + ") where n > 100",
)
def q_high_card(spark, d):
    oc = orders_customers(spark, d)
    k = infer_kinds(oc, Roles(target="o_orderstatus", id="o_orderkey"))
    return k.where("high_cardinality").select("feature")


# ---------------------------------------------------------------- imputation
def _numeric_fit_sql(fill_expr: dict[str, str]) -> str:
    parts = []
    for c in ("n1", "n2"):
        x = f"(case when isnan({c}) then null else {c} end)"
        f = fill_expr[c].format(x=x)
        parts.append(
            f"select '{c}' as feature, round(f, 6) as fill, round(avg(coalesce({x}, f)), 6) as mean, "
            f"round(case when stddev_pop(coalesce({x}, f)) = 0 then 1 else stddev_pop(coalesce({x}, f)) end, 6) as std "
            f"from src, (select {f} as f from src) group by f"
        )
    return " union all ".join(parts)


def _fit(spark, d, **kw):
    return Preparer(DIRTY_ROLES, **kw).fit(dirty(spark, d))


@register("impute_median", f"with src as ({SQL_DIRTY}) " + _numeric_fit_sql({c: "quantile_cont({x}, 0.5)" for c in ("n1", "n2")}))
def q_impute_median(spark, d):
    return rounded(_fit(spark, d).numeric_stats())


@register("impute_mean", f"with src as ({SQL_DIRTY}) " + _numeric_fit_sql({c: "avg({x})" for c in ("n1", "n2")}))
def q_impute_mean(spark, d):
    return rounded(_fit(spark, d, numeric_strategy="mean").numeric_stats())


@register("impute_constant", f"with src as ({SQL_DIRTY}) " + _numeric_fit_sql({c: "-999.0" for c in ("n1", "n2")}))
def q_impute_constant(spark, d):
    return rounded(_fit(spark, d, numeric_strategy="constant").numeric_stats())


_CANON = {
    "n_const": "case when n_const = floor(n_const) then cast(cast(n_const as bigint) as varchar) else cast(n_const as varchar) end",
    "c1": "c1",
    "c2": "cast(c2 as varchar)",
}


def _vc_sql(src: str) -> str:
    return " union all ".join(f"select '{c}' as feature, {e} as value from {src} where {e} is not null" for c, e in _CANON.items())


@register(
    "impute_mode",
    f"""with src as ({SQL_DIRTY}), v as ({_vc_sql('src')}),
vc as (select feature, value, count(*) as cnt from v group by feature, value)
select feature, value as fill from (select feature, value, row_number() over (partition by feature order by cnt desc, value) as r from vc) where r = 1""",
)
def q_impute_mode(spark, d):
    return _fit(spark, d).categorical_fills()


_SQL_DICT = f"""v as ({_vc_sql('tr')}),
dict as (select feature, value, (row_number() over (partition by feature order by value) - 1)::integer as code
         from (select distinct feature, value from v union select distinct feature, '__unknown__' from v))"""
_SQL_TRAIN = f"""src as ({SQL_DIRTY}),
rr as (select *, row_number() over (order by ts, event_id) as rn, count(*) over () as nn from src),
tr as (select * from rr where rn <= floor(nn * {TRAIN!r}::double))"""


@register("dictionary", f"with {_SQL_TRAIN}, {_SQL_DICT} select feature, value, code from dict")
def q_dictionary(spark, d):
    return _fitted_on_train(spark, d).categories


def _fitted_on_train(spark, d):
    lab = S.assign_time_split(dirty(spark, d), "ts", TRAIN, VAL, tiebreak="event_id")
    train, _, _ = S.split_frames(staged(lab, "split"))
    return Preparer(DIRTY_ROLES).fit(train)


_SQL_FITTED = f"""{_SQL_TRAIN}, {_SQL_DICT},
med as (select quantile_cont(case when isnan(n1) then null else n1 end, 0.5) as f1,
               quantile_cont(case when isnan(n2) then null else n2 end, 0.5) as f2 from tr),
modes as (select feature, value as mode from (select feature, value, row_number() over (partition by feature order by count(*) desc, value) as r
          from ({_vc_sql('tr')}) group by feature, value) where r = 1),
sc as (select avg(coalesce(case when isnan(n1) then null else n1 end, f1)) as m1,
              stddev_pop(coalesce(case when isnan(n1) then null else n1 end, f1)) as s1,
              avg(coalesce(case when isnan(n2) then null else n2 end, f2)) as m2,
              stddev_pop(coalesce(case when isnan(n2) then null else n2 end, f2)) as s2 from tr, med group by f1, f2),
enc as (select src.event_id,
          coalesce(case when isnan(src.n1) then null else src.n1 end, f1) as n1,
          coalesce(case when isnan(src.n2) then null else src.n2 end, f2) as n2,
          coalesce(dc.code, (select code from dict where feature = 'n_const' and value = '__unknown__')) as n_const,
          coalesce(d1.code, (select code from dict where feature = 'c1' and value = '__unknown__')) as c1,
          coalesce(d2.code, (select code from dict where feature = 'c2' and value = '__unknown__')) as c2
        from src cross join med
        left join dict dc on dc.feature = 'n_const' and dc.value = coalesce({_CANON['n_const'].replace('n_const', 'src.n_const')}, (select mode from modes where feature = 'n_const'))
        left join dict d1 on d1.feature = 'c1' and d1.value = coalesce(src.c1, (select mode from modes where feature = 'c1'))
        left join dict d2 on d2.feature = 'c2' and d2.value = coalesce(cast(src.c2 as varchar), (select mode from modes where feature = 'c2')))"""


@register(
    "ordinal_encode",
    f"with {_SQL_FITTED} select event_id, round(n1, 6) as n1, round(n2, 6) as n2, n_const, c1, c2 from enc",
)
def q_ordinal_encode(spark, d):
    p = _fitted_on_train(spark, d)
    return rounded(p.transform_for_classifier(dirty(spark, d), passthrough=["event_id"]).drop("y"))


@register(
    "observation_vector",
    f"""with {_SQL_FITTED}
select event_id, position, round(v, 6) as v from enc,
  lateral (select unnest(range(5)) as position, unnest([cast(n1 as float), cast(n2 as float), n_const, c1, c2]::float[])::double as v)""",
)
def q_observation_vector(spark, d):
    p = _fitted_on_train(spark, d)
    obs = p.observation_vector(p.transform_for_classifier(dirty(spark, d), passthrough=["event_id"]), passthrough=["event_id"])
    return rounded(obs.select("event_id", F.posexplode("obs").alias("position", "v")).withColumn("v", F.col("v").cast("double")).withColumn("position", F.col("position").cast("long")))


_Z = "cast((n{i} - m{i}) / (case when s{i} = 0 then 1 else s{i} end) as float)"


@register(
    "standardize",
    f"with {_SQL_FITTED} select event_id, round({_Z.format(i=1)}::double, 6) as z_n1, round({_Z.format(i=2)}::double, 6) as z_n2 from enc, sc",
)
def q_standardize(spark, d):
    p = _fitted_on_train(spark, d)
    g = p.transform_for_gan(dirty(spark, d), passthrough=["event_id"])
    return rounded(g.select("event_id", F.col("numeric")[0].cast("double").alias("z_n1"), F.col("numeric")[1].cast("double").alias("z_n2")))


@register(
    "unstandardize",
    f"""with {_SQL_FITTED}
select event_id,
  round({_Z.format(i=1)}::double * (case when s1 = 0 then 1 else s1 end) + m1, 6) as n1,
  round({_Z.format(i=2)}::double * (case when s2 = 0 then 1 else s2 end) + m2, 6) as n2 from enc, sc""",
)
def q_unstandardize(spark, d):
    p = _fitted_on_train(spark, d)
    g = p.transform_for_gan(dirty(spark, d), passthrough=["event_id"])
    return rounded(p.inverse_transform_gan(g, passthrough=["event_id"]).select("event_id", "n1", "n2"))


@register(
    "one_hot",
    f"""with {_SQL_FITTED}, card as (select feature, count(*) as k from dict group by feature),
cells as (select event_id, 'n_const' as feature, n_const as code from enc union all
          select event_id, 'c1', c1 from enc union all select event_id, 'c2', c2 from enc)
select event_id, 'onehot_' || cells.feature as feature, position, case when position = code then 1.0 else 0.0 end as v
from cells join card using (feature), lateral (select unnest(range(k)) as position)""",
)
def q_one_hot(spark, d):
    p = _fitted_on_train(spark, d)
    g = p.transform_for_gan(dirty(spark, d), passthrough=["event_id"])
    parts = [
        g.select("event_id", F.lit(f"onehot_{c}").alias("feature"), F.posexplode(f"onehot_{c}").alias("position", "v"))
        for c in p.categorical
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("event_id", "feature", F.col("position").cast("long").alias("position"), F.col("v").cast("double").alias("v"))


@register(
    "argmax_decode",
    f"""with {_SQL_FITTED}
select event_id, dc.value as n_const, d1.value as c1, d2.value as c2 from enc
  left join dict dc on dc.feature = 'n_const' and dc.code = enc.n_const
  left join dict d1 on d1.feature = 'c1' and d1.code = enc.c1
  left join dict d2 on d2.feature = 'c2' and d2.code = enc.c2""",
)
def q_argmax_decode(spark, d):
    p = _fitted_on_train(spark, d)
    g = p.transform_for_gan(dirty(spark, d), passthrough=["event_id"])
    return p.inverse_transform_gan(g, passthrough=["event_id"]).select("event_id", "n_const", "c1", "c2")


@register(
    "sparse_one_hot",
    f"""with {_SQL_FITTED}, card as (select feature, count(*) as k from dict group by feature),
cells as (select event_id, 'n_const' as feature, n_const as code from enc union all
          select event_id, 'c1', c1 from enc union all select event_id, 'c2', c2 from enc)
select event_id, cells.feature, k::integer as size, code::integer as "index" from cells join card using (feature)""",
)
def q_sparse_one_hot(spark, d):
    p = _fitted_on_train(spark, d)
    g = p.transform_for_gan(dirty(spark, d), passthrough=["event_id"], sparse=True)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"onehot_{c}").alias("v")) for c in p.categorical]))
    return g.select("event_id", cells.alias("cell")).select("event_id", "cell.feature", "cell.v.size", "cell.v.index")


@register(
    "sparse_decode",
    f"""with {_SQL_FITTED}
select event_id, dc.value as n_const, d1.value as c1, d2.value as c2 from enc
  left join dict dc on dc.feature = 'n_const' and dc.code = enc.n_const
  left join dict d1 on d1.feature = 'c1' and d1.code = enc.c1
  left join dict d2 on d2.feature = 'c2' and d2.code = enc.c2""",
)
def q_sparse_decode(spark, d):
    p = _fitted_on_train(spark, d)
    g = p.transform_for_gan(dirty(spark, d), passthrough=["event_id"], sparse=True)
    return p.inverse_transform_gan(g, passthrough=["event_id"]).select("event_id", "n_const", "c1", "c2")


@register(
    "fitted_spec",
    f"""with {_SQL_TRAIN}, {_SQL_DICT}
select 'n1' as feature, 'numeric' as kind, 0 as position, null::integer as cardinality
union all select 'n2', 'numeric', 1, null
union all select feature, 'categorical', (case feature when 'n_const' then 0 when 'c1' then 1 else 2 end)::integer, count(*)::integer from dict group by feature""",
)
def q_fitted_spec(spark, d):
    return _fitted_on_train(spark, d).spec()


# ---------------------------------------------------------------- weighting
@register(
    "scale_pos_weight",
    f"select round(count(*) filter (where is_fraud = 0) / greatest(count(*) filter (where is_fraud = 1), 1)::double, 6) as scale_pos_weight from ({SQL_TX})",
)
def q_scale_pos_weight(spark, d):
    return rounded(pos_weight_frame(transactions(spark, d), LABEL))
