"""The bootstrap's runs change no result; scoring an empty table gives an empty table."""

import pytest
from pyspark.sql import functions as F

from rarefold.operators import experiment as E
from rarefold.operators.model import PROBA, train_linear


def test_runs_of_any_size_agree(spark, monkeypatch):
    df = spark.range(700).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"), (F.floor(F.col("id") % 40 / 3) / 14).alias("s"))
    answers = []
    for rows in (8192, 17):
        monkeypatch.setattr(E, "RUN_ROWS", rows)
        answers.append([tuple(r) for r in E.bootstrap_metrics(df, "y", "s", "id", 6).orderBy("b").collect()])
    assert len(answers[0]) == 6
    for a, b in zip(*answers):
        assert a == pytest.approx(b, abs=1e-12)


def test_scoring_no_rows(spark):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    none = train_linear(df, ["a"], "y").predict_proba(df.where("a < 0"))
    assert PROBA in none.columns and none.count() == 0
