"""The driver's tables mapped onto the roles of a rare-event dataset.

* transactions: ``events`` (id ``event_id``, time ``ts``); the rare class is a
  purchase above 100 (about 2.4% of rows); ``value``/``user_id`` numeric,
  ``event_type`` categorical.
* scores for metric queries: ``least(value, 400) / 400`` (deterministic, tied).
* the two-table load: ``orders`` left-joined to ``customer`` on the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.sources.io import read_parquet

LABEL = "is_fraud"

# SQL fragments shared by the oracles (the same definitions as below)
SQL_SCORED = (
    "select event_id, user_id, ts, event_type, value, props, "
    "cast(event_type = 'purchase' and value > 100 as integer) as y, "
    "least(value, 400.0) / 400.0 as s from events"
)
SQL_TX = (
    "select event_id, ts, user_id, event_type, value, "
    "cast(event_type = 'purchase' and value > 100 as integer) as is_fraud from events"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        "value",
        "props",
        ((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int").alias("y"),
        (F.least(F.col("value"), F.lit(400.0)) / F.lit(400.0)).alias("s"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        ((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int").alias(LABEL),
    )
