"""Scans and sinks.

S7 (fitted preparation) and S8 (classifier) persist with their models in
``rarefold.operators.prep`` and ``rarefold.operators.model``.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.operators.join import left_join

log = logging.getLogger(__name__)

# Tokens read as missing in CSV input (fixed values, as pandas' reader treats them)
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Probe a path through the Hadoop FileSystem of the session (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def normalise_missing(df: DataFrame) -> DataFrame:
    """String NA tokens (whole cells, blanks count) -> null; NaN in floating columns -> null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _inferred(df: DataFrame) -> DataFrame:
    """String columns as the narrowest of long, double, boolean that takes all their non-null cells, in one pass.

    A column without any value is a double, as in the reader that the tokens come from.
    """
    names = df.columns
    q = [F.col(f"`{n}`") for n in names]
    checks = []
    for i, c in enumerate(q):
        plain = F.trim(c)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count(F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))).alias(f"l{i}"),
            F.count(F.when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"), plain)).alias(f"d{i}"),
            F.count(F.when(c.isin("True", "TRUE", "true", "False", "FALSE", "false"), c)).alias(f"b{i}"),
        ]
    r = df.agg(*checks).first()
    out = []
    for i, (name, c) in enumerate(zip(names, q, strict=True)):
        n = r[f"n{i}"]
        plain = F.trim(c)
        if n and r[f"l{i}"] == n:
            c = plain.cast("bigint")
        elif r[f"d{i}"] == n:
            c = plain.cast("double")
        elif r[f"b{i}"] == n:
            c = F.lower(c) == "true"
        out.append(c.alias(name))
    return df.select(*out)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV. NA tokens become null before types are given: to the types of ``schema`` when known (a cell
    that does not parse is null), else to inferred ones."""
    text = normalise_missing(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))
    if schema is None:
        return _inferred(text)
    fields = schema.fields if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).fields
    return text.select(*[F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in fields])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3: saved table."""
    return spark.read.parquet(path)


def load_raw(
    spark: SparkSession,
    main_path: str,
    second_path: str | None = None,
    key: str | None = None,
    fmt: str = "csv",
    schema=None,
) -> DataFrame:
    """S1 + S2 + J1: main table, left-joined to the optional second table on ``key``.

    The second table is used only if configured and present; otherwise a
    warning is logged and the main table is returned alone.
    """
    reader = (lambda p: read_csv_table(spark, p, schema)) if fmt == "csv" else (lambda p: read_parquet(spark, p))
    main = reader(main_path)
    if second_path and key:
        if path_exists(spark, second_path):
            return left_join(main, reader(second_path), key)
        log.warning("second table %s not found; continuing with the main table only", second_path)
    return main


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Overwrite a parquet table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_report_csv(df: DataFrame, path: str) -> str:
    """A report-sized table as one CSV file with a header, no index column."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_metrics_json(df: DataFrame, path: str) -> str:
    """Metric record(s) as JSON lines (nested confusion matrix kept as an object)."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path
