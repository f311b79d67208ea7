"""Validation and simple filters (V1-V8).

Reports are DataFrames (lazy); the ``check_*`` wrappers run one small job and
raise with the offending values, as the reference does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing(c: Column, dtype) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """V1: raise naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def all_null_columns(df: DataFrame) -> DataFrame:
    """V2: (column) for every column with no non-missing value (NaN counts as missing). One pass."""
    fields = df.schema.fields
    agg = df.agg(
        *[F.count_if(~_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)]
    )
    pairs = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f"n{i}").alias("n")) for i, f in enumerate(fields)])
    return agg.select(F.explode(pairs).alias("p")).where(F.col("p.n") == 0).select("p.feature")


def label_values(df: DataFrame, target: str) -> DataFrame:
    """V3 data: the distinct non-null label values."""
    return df.select(F.col(target).alias("label")).where(F.col("label").isNotNull()).distinct()


def check_binary_target(df: DataFrame, target: str) -> DataFrame:
    """V3: distinct non-null labels must lie in {0, 1}; else raise with (up to 5) offenders."""
    bad = label_values(df, target).where(~F.col("label").isin(0, 1)).limit(5).collect()
    if bad:
        raise ValueError(f"target {target} is not binary; found values {[r['label'] for r in bad]}")
    return df


def nonfinite_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """V4: (column) for listed numeric columns holding +-inf; null is finite, unknown names ignored."""
    fields = [f for f in df.schema.fields if f.name in set(cols) and isinstance(f.dataType, T.NumericType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "feature string")
    agg = df.agg(
        *[F.count_if(F.abs(F.col(f"`{f.name}`").cast("double")) == float("inf")).alias(f"n{i}") for i, f in enumerate(fields)]
    )
    pairs = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f"n{i}").alias("n")) for i, f in enumerate(fields)])
    return agg.select(F.explode(pairs).alias("p")).where(F.col("p.n") > 0).select("p.feature")


def positive_count(df: DataFrame, target: str) -> DataFrame:
    """V5 data: one row with the number of positive rows."""
    return df.agg(F.count_if(F.col(target) == 1).cast("long").alias("n_positive"))


def check_class_balance(df: DataFrame, target: str, min_positive: int = 10) -> DataFrame:
    """V5: fewer than ``min_positive`` positives -> raise."""
    n = positive_count(df, target).first()["n_positive"]
    if n < min_positive:
        raise ValueError(f"only {n} positive rows (< {min_positive})")
    return df


def minority_rows(df: DataFrame, target: str, numeric: Sequence[str], positive=1) -> DataFrame:
    """V7: rows of the rare class, numeric columns only."""
    return df.where(F.col(target) == positive).select(*numeric)


def kept_rows(df: DataFrame, keep: str = "keep") -> DataFrame:
    """V8: rows whose keep flag is true."""
    return df.where(F.col(keep))
