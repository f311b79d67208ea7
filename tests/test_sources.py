import json

from pyspark.sql import functions as F

from rarefold.operators import split as S
from rarefold.operators.join import union_rows
from rarefold.sources import io


def write(path, text):
    path.write_text(text)
    return str(path)


def test_types_come_after_missing_tokens(spark, tmp_path):
    p = write(tmp_path / "t.csv", "id,a,b,c,d,e\n1,1.5,NA,x,True,-1.#IND\n2,NA,7,  NA ,False,\n3,2.5,n/a,null,#N/A N/A,1.#QNAN\n")
    df = io.read_csv_table(spark, p)
    assert dict(df.dtypes) == {"id": "bigint", "a": "double", "b": "bigint", "c": "string", "d": "boolean", "e": "double"}
    rows = df.orderBy("id").collect()
    assert [r.a for r in rows] == [1.5, None, 2.5] and [r.b for r in rows] == [None, 7, None]
    assert [r.c for r in rows] == ["x", "  NA ", None] and [r.d for r in rows] == [True, False, None] and [r.e for r in rows] == [None] * 3


def test_declared_types(spark, tmp_path):
    p = write(tmp_path / "t.csv", "id,a\n1,NA\n2,3\n3,oops\n")
    df = io.read_csv_table(spark, p, "id int, a double")
    assert df.dtypes == [("id", "int"), ("a", "double")] and [r.a for r in df.orderBy("id").collect()] == [None, 3.0, None]


def test_numbers_of_every_form(spark, tmp_path):
    p = write(tmp_path / "t.csv", "a,b,c\n 12 ,1e3,99999999999999999999\n-7,.5,1\n+3,-inf,2\n")
    df = io.read_csv_table(spark, p)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "double"}
    assert [r.a for r in df.collect()] == [12, -7, 3]


def test_second_table_is_optional(spark, tmp_path):
    main = write(tmp_path / "m.csv", "k,v\n1,a\n2,b\n")
    other = write(tmp_path / "o.csv", "k,w\n2,9\n")
    assert io.load_raw(spark, main, str(tmp_path / "none.csv"), "k").columns == ["k", "v"]
    got = {r.k: r.w for r in io.load_raw(spark, main, other, "k").collect()}
    assert got == {1: None, 2: 9}


def test_reports_read_back(spark, tmp_path):
    df = spark.createDataFrame([("as_is", 0.25, {"tn": 1, "fp": 2})], "scenario string, auc_pr double, cm struct<tn: int, fp: int>")
    path = io.write_report_csv(df.drop("cm"), str(tmp_path / "r"))
    assert [r.asDict() for r in spark.read.csv(path, header=True, inferSchema=True).collect()] == [{"scenario": "as_is", "auc_pr": 0.25}]
    path = io.write_metrics_json(df, str(tmp_path / "j"))
    [line] = [x for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"scenario": "as_is", "auc_pr": 0.25, "cm": {"tn": 1, "fp": 2}}
    back = io.read_parquet(spark, io.write_parquet(df, str(tmp_path / "p"), ["scenario"]))
    assert back.count() == 1 and back.first().auc_pr == 0.25


def test_split_dispatch_and_union(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"), (100 - F.col("id")).alias("t"))
    by_time = S.assign_split(df, "y", "id", "t")
    assert by_time.where("split = 'train'").agg(F.min("t")).first()[0] == 1
    by_class = S.assign_split(df, "y", "id", "absent")
    assert by_class.where("split = 'train' and y = 1").count() == 17
    assert union_rows([df, df.select("t", "y", "id")]).count() == 200
