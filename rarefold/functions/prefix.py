"""Exact global running sums without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task. Here
the rows are range-partitioned on the whole order (order column, then tie-break,
of any orderable types), so a value that holds a large share of the rows is
split on its tie-break. Each range's totals give the offsets of the ranges after
it (one row per range and group), and an ordinary window adds the running sum
inside each range. The ranges are written once to the shared folder, so totals
and rows see the same cut; where the cuts fall changes balance, never the answer.

Without a tie-break, equal order values are peers: they are summed first, the
distinct values get running totals, and the rows look theirs up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.session import staged

_KEY, _RANGE = "__rt_key", "__rt_range"


def _order_value(df: DataFrame, name: str) -> Column:
    """The column itself; NaN counts as null in floating columns."""
    t = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return F.nanvl(c, F.lit(None).cast(t)) if isinstance(t, (T.DoubleType, T.FloatType)) else c


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side's keys are dropped."""
    r = right.select(*[F.col(f"`{c}`").alias(f"__r{keys.index(c)}" if c in keys else c) for c in right.columns])
    cond = None
    for i, k in enumerate(keys):
        one = left[f"`{k}`"].eqNullSafe(r[f"__r{i}"])
        cond = one if cond is None else cond & one
    return left.join(r, cond).drop(*[f"__r{i}" for i in range(len(keys))])


def _ordered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], ranges: int) -> DataFrame:
    g = [F.col(f"`{c}`") for c in groups]
    rows = staged(df.repartitionByRange(ranges, *[c.asc() for c in g], *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    tot = rows.groupBy(*g, _RANGE).agg(*[F.sum(e).alias(f"__tot_{k}") for k, e in sums.items()])
    before = Window.partitionBy(*g).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*g, _RANGE, *[F.coalesce(F.sum(f"__tot_{k}").over(before), F.lit(0)).alias(f"__off_{k}") for k in sums])
    inside = Window.partitionBy(*g, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # without groups there is a row a range: sent to the rows, which then move once less
    j = null_safe_join(rows, offs if g else F.broadcast(offs), [*groups, _RANGE])
    return j.select("*", *[(F.col(f"__off_{k}") + F.sum(e).over(inside)).alias(k) for k, e in sums.items()]).drop(_RANGE, *[f"__off_{k}" for k in sums])


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column | str],
    *,
    descending: bool = False,
    tiebreak: str | None = None,
    partition_by: Sequence[str] = (),
    n_buckets: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add inclusive running sums in the global order of ``order`` (then ``tiebreak``).

    Without a tie-break, rows with equal ``order`` are peers and share one total (SQL ``RANGE``
    frame), unless ``unique`` says that there are none. With one, the order is total (``ROWS``
    frame). Nulls come first ascending and last descending, as in Spark; NaN counts as null.
    """
    pb = list(partition_by)
    ranges = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    base = df.withColumn(_KEY, _order_value(df, order))
    by = lambda c: F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_first()
    if tiebreak is not None or unique:
        ties = [F.col(f"`{tiebreak}`").asc_nulls_first()] if tiebreak is not None else []
        return _ordered(base, pb, [by(_KEY), *ties], exprs, ranges).drop(_KEY)
    values = base.groupBy(*pb, _KEY).agg(*[F.sum(e).alias(f"__sum_{k}") for k, e in exprs.items()])
    totals = _ordered(values, pb, [by(_KEY)], {k: F.col(f"__sum_{k}") for k in exprs}, ranges)
    return null_safe_join(base, totals.drop(*[f"__sum_{k}" for k in exprs]), [*pb, _KEY]).drop(_KEY)


def global_row_number(
    df: DataFrame,
    order: str,
    tiebreak: str | None = None,
    *,
    out: str = "rn",
    descending: bool = False,
    partition_by: Sequence[str] = (),
    n_buckets: int | None = None,
) -> DataFrame:
    """1-based row number in (order, tiebreak) order; ``tiebreak`` must make it unique.

    When ``order`` itself is unique, ``tiebreak`` may be omitted.
    """
    return running_totals(
        df,
        order,
        {out: F.lit(1).cast("long")},
        descending=descending,
        tiebreak=tiebreak if tiebreak is not None else order,
        partition_by=partition_by,
        n_buckets=n_buckets,
    )
