"""Train / validation / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.functions.prefix import global_row_number
from rarefold.functions.rng import uniform

TRAIN, VAL, TEST = "train", "val", "test"


def assign_time_split(df: DataFrame, time: str, train_ratio: float = 0.7, val_ratio: float = 0.15, tiebreak: str | None = None, out: str = "split") -> DataFrame:
    """Earliest ``int(n * train)`` rows train, up to ``int(n * (train + val))`` val, rest test.

    Ties on time are broken by ``tiebreak`` (the id) so the split is
    deterministic; the global order is an exact bucketed row number.
    """
    n = df.count()
    train_end = int(n * train_ratio)
    val_end = int(n * (train_ratio + val_ratio))
    r = global_row_number(df, time, tiebreak, out="__rn")
    lab = F.when(F.col("__rn") <= train_end, F.lit(TRAIN)).when(F.col("__rn") <= val_end, F.lit(VAL)).otherwise(F.lit(TEST))
    return r.withColumn(out, lab).drop("__rn")


def assign_random_split(
    df: DataFrame,
    target: str,
    id_col: str,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    test_ratio: float = 0.15,
    seed: int = 42,
    stratify: bool = True,
    out: str = "split",
) -> DataFrame:
    """Per class (or over all rows), rows in portable-hash order; the first
    ``floor(n_c * train)`` train, then ``floor(rest * val / (val + test))`` val, rest test."""
    if abs(train_ratio + val_ratio + test_ratio - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1")
    rem = val_ratio / (val_ratio + test_ratio)
    grp = F.col(target) if stratify else F.lit(0)
    base = df.withColumn("__u", uniform(seed, "split", id_col)).withColumn("__g", grp)
    counts = base.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    # one row per class (binary target): bounded
    ranked = global_row_number(base, "__u", id_col, out="__rn", partition_by=["__g"])
    j = ranked.join(F.broadcast(counts), "__g")
    n_tr = F.floor(F.col("__n") * F.lit(float(train_ratio)))
    n_va = F.floor((F.col("__n") - n_tr) * F.lit(float(rem)))
    lab = F.when(F.col("__rn") <= n_tr, F.lit(TRAIN)).when(F.col("__rn") <= n_tr + n_va, F.lit(VAL)).otherwise(F.lit(TEST))
    return j.withColumn(out, lab).drop("__u", "__g", "__n", "__rn")


def assign_split(df: DataFrame, target: str, id_col: str | None, time: str | None, **kw) -> DataFrame:
    """Time column configured and present -> time split, else random (stratified) split."""
    if time and time in df.columns:
        ratios = {k: kw[k] for k in ("train_ratio", "val_ratio") if k in kw}
        return assign_time_split(df, time, **ratios, tiebreak=id_col)
    if id_col is None:
        raise ValueError("a random split needs an id column for its portable hash")
    return assign_random_split(df, target, id_col, **kw)


def split_frames(labelled: DataFrame, col: str = "split") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(labelled.where(F.col(col) == s).drop(col) for s in (TRAIN, VAL, TEST))  # type: ignore[return-value]


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """One row (negative, positive); an absent class counts 0."""
    return df.agg(
        F.count_if(F.col(target) == 0).cast("long").alias("negative"),
        F.count_if(F.col(target) == 1).cast("long").alias("positive"),
    )
