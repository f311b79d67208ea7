"""What several fits read is written once, and training rows travel as blocks."""

from pyspark.sql import functions as F

from rarefold.operators import boost
from rarefold.plans.q_select import selection_inputs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_selection_inputs_are_written_once(spark):
    for part in selection_inputs(spark, SF):
        assert not any(step in plan(part) for step in ("Window", "Join", "Repartition"))


def test_training_rows_travel_as_blocks(spark, monkeypatch):
    seen = []
    whole = boost.staged

    def counted(df, name, keep_path=False):
        out = whole(df, name, keep_path)
        seen.append((name, out[0].count()))
        return out

    monkeypatch.setattr(boost, "staged", counted)
    monkeypatch.setattr(boost, "ROWS", 1000)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 400)
    rows = spark.range(2000).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 5).cast("int").alias("c"), (F.col("id") % 37 > 20).cast("int").alias("y"))
    val = spark.createDataFrame([(float(i % 37), 5000 + i, int(i % 37 > 20)) for i in range(100)], "a double, c int, y int")  # codes that training has not seen
    p = boost.BoostParams(max_iter=3, max_depth=2, subsample=1.0, colsample=1.0, early_stopping_rounds=2, step_size=0.3)
    m = boost.train_boosted(rows, ["a", "c"], "y", val.coalesce(1), params=p, categorical=["c"])
    assert all(n == 6 for name, n in seen if name == "boost-train")  # 2 partitions of 1000 rows, 3 blocks each
    assert all(n == 1 for name, n in seen if name == "boost-val")
    assert len(m.scores) == 3 and m.scores[-1] == 1.0


def test_neighbour_blocks_are_not_merged_into_one_task(spark):
    from rarefold.operators.oversample import knn_within

    points = spark.range(600).select("id", (F.col("id") * 37 % 601).cast("double").alias("a"), (F.col("id") % 3).cast("int").alias("c"))
    nn = knn_within(points, "id", ["a"], ["c"], k=2, penalty=5.0, block_rows=64)
    assert nn.count() == 1200
    steps = nn._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in steps and "SortMergeJoin" in steps
