import pytest
from pyspark.sql import functions as F

from rarefold.operators import validate as V
from rarefold.operators.prep import UNKNOWN, Preparer, PreparedFeatures, Roles, dense_one_hot, infer_kinds


def test_kinds_thresholds(spark):
    rows = [(i % 20, i % 21, i % 2 == 0, f"s{i % 101}", 0) for i in range(420)]
    df = spark.createDataFrame(rows, "a int, b int, flag boolean, s string, y int")
    k = {r["feature"]: (r["kind"], r["high_cardinality"]) for r in infer_kinds(df, Roles(target="y")).collect()}
    assert k["a"][0] == "categorical" and k["b"][0] == "numeric"
    assert k["flag"][0] == "categorical"
    assert k["s"] == ("categorical", True)


def test_dictionary_order_unknown_and_unseen(spark):
    fit = spark.createDataFrame([(c, 0) for c in ["10", "2", "Visa", "visa", "Z"]], "c string, y int")
    p = Preparer(Roles(target="y")).fit(fit)
    codes = {r["value"]: r["code"] for r in p.categories.collect()}
    assert sorted(codes, key=codes.get) == ["10", "2", "Visa", "Z", UNKNOWN, "visa"]
    app = spark.createDataFrame([("2",), ("new",), (None,)], "c string")
    out = [r["c"] for r in p.transform_for_classifier(app).collect()]
    # null -> most frequent (smallest on ties: "10"); unseen -> unknown
    assert out == [codes["2"], codes[UNKNOWN], codes["10"]]


def test_numeric_category_int_and_double_share_codes(spark):
    fit = spark.createDataFrame([(1, 0), (2, 0), (1, 1)], "c int, y int")
    p = Preparer(Roles(target="y")).fit(fit)
    app = spark.createDataFrame([(1.0,), (2.0,), (None,)], "c double")
    out = [r["c"] for r in p.transform_for_classifier(app).collect()]
    codes = {r["value"]: r["code"] for r in p.categories.collect()}
    assert out == [codes["1"], codes["2"], codes["1"]]


def test_dirty_columns(spark):
    rows = [(float(i) if i % 4 else None, float("nan") if i % 5 == 0 else float(i), None, 3.0, "a" if i % 2 else None, i % 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "n1 double, n2 double, n_null double, n_const double, c1 string, c2 int, y int")
    assert [r["feature"] for r in V.all_null_columns(df).collect()] == ["n_null"]
    p = Preparer(Roles(target="y")).fit(df)
    assert p.dropped == ["n_null"]
    assert "n_const" in p.categorical and p.numeric == ["n1", "n2"]
    g = p.transform_for_gan(df)
    assert all(len(r["numeric"]) == 2 for r in g.collect())
    with pytest.raises(RuntimeError):
        Preparer(Roles(target="y")).transform_for_classifier(df)
    with pytest.raises(ValueError):
        V.check_binary_target(spark.createDataFrame([(0,), (2,)], "y int"), "y")
    with pytest.raises(ValueError):
        V.check_class_balance(df, "y", 100)
    with pytest.raises(ValueError):
        V.require_columns(df, ["n1", "zz"])


def test_zero_variance_scales_by_one_and_save_load(spark, tmp_path):
    rows = [(float(i), 5.0 + 0 * i, "x" if i % 3 else "y", i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c string, y int")
    p = Preparer(Roles(target="y"), low_cardinality=0).fit(df)
    assert p.stds["b"] == 1.0
    path = str(tmp_path / "prep")
    p.save(path)
    q = PreparedFeatures.load(spark, path)
    a = sorted(p.transform_for_classifier(df).collect())
    b = sorted(q.transform_for_classifier(df).collect())
    assert a == b
    inv = q.inverse_transform_gan(q.transform_for_gan(df)).collect()
    assert sorted(r["c"] for r in inv) == sorted(r[2] for r in rows)


def test_sparse_one_hot_is_one_entry_a_row(spark):
    n = 100_000
    fit = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("c"), (F.col("id") % 2).cast("int").alias("y"))
    p = Preparer(Roles(target="y")).fit(fit)
    assert p.categorical == ["c"]
    g = p.transform_for_gan(fit, sparse=True)
    got = g.agg(F.min("onehot_c.size"), F.max("onehot_c.size"), F.count_distinct("onehot_c.index"), F.min("onehot_c.index"), F.max("onehot_c.index")).first()
    assert got[0] == got[1] == n + 1  # the unknown value is a category too; it sorts before "k..." and takes code 0
    assert got[2:] == (n, 1, n)
    back = p.inverse_transform_gan(p.transform_for_gan(fit.withColumn("id", F.col("c")), passthrough=["id"], sparse=True), passthrough=["id"])
    assert back.where(F.col("id") == F.col("c")).count() == n


def test_sparse_one_hot_equals_the_dense_one(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), (None, 0), ("c", 1), ("a", 0)], "c string, y int").withColumn("id", F.monotonically_increasing_id())
    p = Preparer(Roles(target="y", id="id")).fit(df)
    app = spark.createDataFrame([(1, "a"), (2, "new"), (3, None), (4, "c")], "id long, c string")
    dense = {r["id"]: r["onehot_c"] for r in p.transform_for_gan(app, passthrough=["id"]).collect()}
    wide = p.transform_for_gan(app, passthrough=["id"], sparse=True).select("id", dense_one_hot(F.col("onehot_c")).alias("v"))
    assert {r["id"]: r["v"] for r in wide.collect()} == dense
