"""The flagship plan: load two tables -> split by time -> fit preparation on the
training part -> weighted boosted trees -> one metric row on the test part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.operators import metrics as M
from rarefold.operators import split as S
from rarefold.operators.join import left_join
from rarefold.operators.boost import PROBA, train_main_classifier
from rarefold.operators.prep import Preparer, Roles
from rarefold.plans.tables import table
from rarefold.session import staged

ROLES = Roles(target="is_f", id="o_orderkey", time="o_orderdate", drop=("o_orderstatus", "custkey"))
# the declared classifier, cut to 30 trees so that the smoke run is quick; the best prefix by AUC-PR stays
FLAGSHIP_PARAMS = dict(max_iter=30)


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("is_f"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey", "c_acctbal", "c_mktsegment")
    return left_join(o, c, "custkey")


def flagship(spark: SparkSession, sf_dir: str, params: dict | None = None) -> DataFrame:
    raw = orders_with_customers(spark, sf_dir)
    lab = S.assign_time_split(raw, "o_orderdate", 0.7, 0.15, tiebreak="o_orderkey")
    train, val, test = S.split_frames(staged(lab, "split"))
    prep = Preparer(ROLES).fit(train)
    tv, vv, sv = (staged(prep.transform_for_classifier(x), "view") for x in (train, val, test))
    clf = train_main_classifier(tv, prep.features, ROLES.target, vv, params=dict(FLAGSHIP_PARAMS, **(params or {})), categorical=prep.categorical)
    scored = clf.predict_proba(sv)
    return M.metric_row(scored, ROLES.target, PROBA, flat=True)
