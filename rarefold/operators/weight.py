"""Class weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pos_weight_frame(df: DataFrame, target: str, scale_pos_weight="auto") -> DataFrame:
    """One row ``scale_pos_weight`` = negatives / max(positives, 1) for "auto", else the number."""
    if scale_pos_weight != "auto":
        return df.sparkSession.range(1).select(F.lit(float(scale_pos_weight)).alias("scale_pos_weight"))
    return df.agg(
        (F.count_if(F.col(target) == 0).cast("double") / F.greatest(F.count_if(F.col(target) == 1), F.lit(1)).cast("double")).alias("scale_pos_weight")
    )


def pos_weight(df: DataFrame, target: str, scale_pos_weight="auto") -> float:
    return float(pos_weight_frame(df, target, scale_pos_weight).first()["scale_pos_weight"])


def weight_column(target: str, w: float) -> Column:
    """Row weight for a weighted fit: ``w`` for positives, 1 otherwise."""
    return F.when(F.col(target) == 1, F.lit(float(w))).otherwise(F.lit(1.0))


def with_class_weight(df: DataFrame, target: str, scale_pos_weight="auto", out: str = "weight") -> DataFrame:
    w = pos_weight(df, target, scale_pos_weight)
    return df.withColumn(out, weight_column(target, w))
