"""Joins and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Keep every left row; right duplicates multiply; the key appears once.

    Null keys match null keys (null-safe equality), other colliding names get
    the suffixes. Spark chooses broadcast or sort-merge from the sizes (AQE
    re-plans at runtime), so no hint is given for a side of unknown size.
    """
    lcols = [c for c in left.columns if c != key]
    rcols = [c for c in right.columns if c != key]
    clash = set(lcols) & set(rcols)
    lsel = [F.col(key).alias("__lk")] + [F.col(f"`{c}`").alias(c + suffixes[0] if c in clash else c) for c in lcols]
    rsel = [F.col(key).alias("__rk")] + [F.col(f"`{c}`").alias(c + suffixes[1] if c in clash else c) for c in rcols]
    lt, rt = left.select(*lsel), right.select(*rsel)
    j = lt.join(rt, lt["__lk"].eqNullSafe(rt["__rk"]), "left")
    out = [F.col("__lk").alias(key)]
    out += [F.col(f"`{c + suffixes[0] if c in clash else c}`") for c in lcols]
    out += [F.col(f"`{c + suffixes[1] if c in clash else c}`") for c in rcols]
    return j.select(*out)


def union_rows(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Union all by column name (index reset is implicit in Spark)."""
    it = iter(frames)
    out = next(it)
    for f in it:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def stack_with_origin(real: DataFrame, synthetic: DataFrame, cols: Sequence[str], origin: str = "origin") -> DataFrame:
    """Real and synthetic rows stacked for a joint projection, tagged by origin."""
    a = real.select(*cols).withColumn(origin, F.lit("real"))
    b = synthetic.select(*cols).withColumn(origin, F.lit("synthetic"))
    return a.unionByName(b)
