"""Ranking and threshold metrics for a scored binary table.

Everything starts from one curve table: rows grouped by (group..., score) into
(pos, cnt), then exact running sums in descending score order (ties grouped
first, so a tie never splits). AUC-ROC, average precision, recall at a fixed
false-positive rate, and the PR / ROC points are column arithmetic over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.prefix import global_row_number, null_safe_join, running_totals

DEFAULT_FPR_TARGETS = (1e-3, 1e-4)

# Fixed report order (values that define the text report, I9)
REPORT_KEYS = ("auc_pr", "auc_roc", "f1", "precision", "recall", "mcc")
# Metrics shown by the scenario comparison
COMPARISON_METRICS = ("auc_pr", "auc_roc", "f1", "recall")


def fpr_key(target: float) -> str:
    """Column name of a recall-at-FPR metric, e.g. ``recall_at_fpr_1e-03``."""
    return f"recall_at_fpr_{target:.0e}"


def _g(group_cols: Sequence[str]) -> list[str]:
    return list(group_cols)


def hard_prediction(score: Column | str, threshold: float = 0.5) -> Column:
    """``score >= threshold`` as 0/1."""
    s = F.col(score) if isinstance(score, str) else score
    return (s >= F.lit(threshold)).cast("int")


def _scored(df: DataFrame, label: str, score: str, nulls: str) -> DataFrame:
    """The rule for missing values: ``raise`` fails on a null or NaN score or a null label; ``lowest``
    leaves out rows without a label and ranks rows without a score below all others."""
    if nulls not in ("raise", "lowest"):
        raise ValueError(f"nulls must be 'raise' or 'lowest', not {nulls!r}")
    kind = df.schema[score].dataType
    s = F.col(score)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        s = F.nanvl(s, F.lit(None).cast(kind))
    if nulls == "lowest":
        return df.where(F.col(label).isNotNull()).withColumn(score, s)
    missing = F.raise_error(F.lit(f"a score or label is missing ({score}, {label})")).cast(kind)
    return df.withColumn(score, F.when(s.isNull() | F.col(label).isNull(), missing).otherwise(s))


def curve_table(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (), weight: str | None = None, nulls: str = "raise") -> DataFrame:
    """Per (group, distinct score): pos, neg, cnt and running cum_pos/cum_neg/cum_cnt
    in descending score order, plus the group's P and N. ``weight`` counts a row
    that many times. Missing scores: see ``_scored``."""
    g = _g(group_cols)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    grouped = _scored(df, label, score, nulls).groupBy(*g, score).agg(
        F.sum(F.col(label).cast("long") * w).alias("pos"), F.sum(w).alias("cnt")
    )
    grouped = grouped.withColumn("neg", F.col("cnt") - F.col("pos"))
    cur = running_totals(
        grouped,
        score,
        {"cum_pos": F.col("pos"), "cum_cnt": F.col("cnt")},
        descending=True,
        partition_by=g,
        unique=True,
    ).withColumn("cum_neg", F.col("cum_cnt") - F.col("cum_pos"))
    totals = cur.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if g:
        return null_safe_join(cur, totals, g)
    # one-row totals, joined on a constant key
    one = F.lit(1)
    return cur.withColumn("__one", one).join(F.broadcast(totals.withColumn("__one", one)), "__one").drop("__one")


def ranking_metrics(
    df: DataFrame,
    label: str,
    score: str,
    group_cols: Sequence[str] = (),
    fpr_targets: Sequence[float] = DEFAULT_FPR_TARGETS,
    weight: str | None = None,
    nulls: str = "raise",
) -> DataFrame:
    """I3 (auc_roc), I4 (auc_pr), I7 (recall_at_fpr_*) per group; undefined -> null.

    Counts are longs; products of counts are taken in double, as they pass 2^63 at a few billion rows."""
    g = _g(group_cols)
    c = curve_table(df, label, score, g, weight, nulls)
    P, N = F.first("P").cast("double"), F.first("N").cast("double")
    below = F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0
    aggs = [
        (F.sum(F.col("neg").cast("double") * below) / F.nullif(P * N, F.lit(0.0))).alias("auc_roc"),
        (F.sum(F.col("pos") * (F.col("cum_pos") / F.col("cum_cnt"))) / F.nullif(P, F.lit(0.0))).alias("auc_pr"),
    ]
    for t in fpr_targets:
        hit = F.max(F.when(F.col("cum_neg") <= F.lit(t) * F.col("N"), F.col("cum_pos")))
        aggs.append((F.coalesce(hit, F.lit(0)) / F.nullif(P, F.lit(0.0))).alias(fpr_key(t)))
    out = c.groupBy(*g).agg(*aggs, F.first("P").alias("__P"), F.first("N").alias("__N"))
    undefined = (F.col("__P") == 0) | (F.col("__N") == 0)
    cols = ["auc_roc", "auc_pr"] + [fpr_key(t) for t in fpr_targets]
    return out.select(
        *g,
        *[
            F.when(undefined if k != "auc_pr" else F.col("__P") == 0, F.lit(None)).otherwise(F.col(k)).cast("double").alias(k)
            for k in cols
        ],
    )


def confusion_counts(df: DataFrame, label: str, score: str, threshold: float = 0.5, group_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Tn, fp, fn, tp per group (label order 0, 1 even if a class is absent). A missing score predicts 0."""
    g = _g(group_cols)
    y = F.col(label)
    p = F.coalesce(hard_prediction(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")), threshold), F.lit(0))
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")

    def cnt(cond):
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("long")

    return df.groupBy(*g).agg(
        cnt((y == 0) & (p == 0)).alias("tn"),
        cnt((y == 0) & (p == 1)).alias("fp"),
        cnt((y == 1) & (p == 0)).alias("fn"),
        cnt((y == 1) & (p == 1)).alias("tp"),
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def with_threshold_metrics(cm: DataFrame) -> DataFrame:
    """I5 + I6 from confusion counts: precision, recall, f1 (0 if undefined), mcc (0 if undefined)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return cm.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": _ratio(tp * tn - fp * fn, den),
        }
    )


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, group_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return with_threshold_metrics(confusion_counts(df, label, score, threshold, group_cols, weight))


def metric_row(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float = 0.5,
    fpr_targets: Sequence[float] = DEFAULT_FPR_TARGETS,
    group_cols: Sequence[str] = (),
    flat: bool = False,
    nulls: str = "raise",
) -> DataFrame:
    """I8: the full metric record, one row per group.

    Columns: group..., auc_roc, auc_pr, f1, precision, recall, mcc,
    confusion_matrix STRUCT<tn, fp, fn, tp> (or four flat columns), recall_at_fpr_*.
    """
    g = _g(group_cols)
    r = ranking_metrics(df, label, score, g, fpr_targets, nulls=nulls)
    t = threshold_metrics(df, label, score, threshold, g)
    if g:
        j = null_safe_join(r, t, g)
    else:
        j = r.withColumn("__one", F.lit(1)).join(t.withColumn("__one", F.lit(1)), "__one").drop("__one")
    cm = ["tn", "fp", "fn", "tp"]
    cm_cols = [F.col(c) for c in cm] if flat else [F.struct(*[F.col(c) for c in cm]).alias("confusion_matrix")]
    return j.select(
        *g,
        "auc_roc",
        "auc_pr",
        "f1",
        "precision",
        "recall",
        "mcc",
        *cm_cols,
        *[fpr_key(x) for x in fpr_targets],
    )


def metrics_report(metrics: DataFrame, name: Column | str = "model", fpr_targets: Sequence[float] = DEFAULT_FPR_TARGETS) -> DataFrame:
    """A text report per metric row (fixed key order, 4 decimals)."""
    nm = F.lit(name) if isinstance(name, str) and name not in metrics.columns else (F.col(name) if isinstance(name, str) else name)
    cm = (lambda c: F.col(f"confusion_matrix.{c}")) if "confusion_matrix" in metrics.columns else (lambda c: F.col(c))
    lines = [F.format_string("=== Evaluation: %s ===", nm)]
    lines += [F.format_string("  %12s: %.4f", F.lit(k), F.col(k)) for k in REPORT_KEYS]
    lines += [F.format_string("  %20s: %.4f", F.lit(fpr_key(t)), F.col(f"`{fpr_key(t)}`")) for t in fpr_targets]
    lines.append(
        F.format_string("  confusion_matrix : TP=%d FP=%d FN=%d TN=%d", cm("tp"), cm("fp"), cm("fn"), cm("tn"))
    )
    return metrics.withColumn("report", F.concat_ws("\n", *lines))


def pr_curve(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., threshold, precision, recall) per distinct score, plus the end point (1, 0)."""
    g = _g(group_cols)
    c = curve_table(df, label, score, g)
    pts = c.select(
        *g,
        F.col(score).cast("double").alias("threshold"),
        (F.col("cum_pos") / F.col("cum_cnt")).alias("precision"),
        (F.col("cum_pos") / F.nullif(F.col("P"), F.lit(0))).alias("recall"),
    )
    end = c.select(*g).distinct() if g else df.sparkSession.range(1).select()
    end = end.select(*g, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def roc_curve(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (), drop_intermediate: bool = False) -> DataFrame:
    """(group..., threshold, fpr, tpr) from (0, 0, +inf) through every distinct score.

    ``drop_intermediate`` removes points collinear with both neighbours (a
    second difference of zero in both fp and tp counts), as the reference's
    library does; the default keeps every point.
    """
    g = _g(group_cols)
    c = curve_table(df, label, score, g)
    pts = c.select(*g, F.col(score).cast("double").alias("threshold"), "cum_neg", "cum_pos", "N", "P")
    start = c.select(*g, "N", "P").distinct().select(
        *g, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("cum_neg"),
        F.lit(0).cast("long").alias("cum_pos"), "N", "P",
    )
    allp = pts.unionByName(start)
    if drop_intermediate:
        # threshold is unique per group; +inf (the start) sorts first in descending order
        ranked = global_row_number(allp, "threshold", descending=True, partition_by=g, out="__i")
        nb = ranked.select(*g, "__i", "cum_neg", "cum_pos")
        prev = nb.select(*g, (F.col("__i") + 1).alias("__i"), F.col("cum_neg").alias("__pn"), F.col("cum_pos").alias("__pp"))
        nxt = nb.select(*g, (F.col("__i") - 1).alias("__i"), F.col("cum_neg").alias("__nn"), F.col("cum_pos").alias("__np"))
        j = ranked.join(prev, [*g, "__i"], "left").join(nxt, [*g, "__i"], "left")
        keep = (
            F.col("__pn").isNull()
            | F.col("__nn").isNull()
            | ((F.col("__nn") - 2 * F.col("cum_neg") + F.col("__pn")) != 0)
            | ((F.col("__np") - 2 * F.col("cum_pos") + F.col("__pp")) != 0)
        )
        allp = j.where(keep).select(*g, "threshold", "cum_neg", "cum_pos", "N", "P")
    return allp.select(
        *g,
        "threshold",
        (F.col("cum_neg") / F.nullif(F.col("N"), F.lit(0))).alias("fpr"),
        (F.col("cum_pos") / F.nullif(F.col("P"), F.lit(0))).alias("tpr"),
    )


def confusion_grid(cm: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Long 2x2 form (actual, predicted, count) of confusion counts."""
    g = _g(group_cols)
    flat = cm
    if "confusion_matrix" in cm.columns:
        flat = cm.select(*g, *[F.col(f"confusion_matrix.{c}").alias(c) for c in ("tn", "fp", "fn", "tp")])
    return flat.select(
        *g,
        F.expr(
            "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, count)"
        ),
    ).withColumn("count", F.col("count").cast("long"))


def moving_average(df: DataFrame, order: str, value: str, window: int = 20, tiebreak: str | None = None, out: str = "moving_avg") -> DataFrame:
    """Mean of the last ``window`` values in ``order``; null until ``window`` rows exist.

    Rows are cut into blocks by their global position; a block also gets the ``window - 1`` rows
    before it, so each row is copied at most once and an ordinary window does the rest.
    """
    block = max(10_000, 20 * window)
    ranked = global_row_number(df, order, tiebreak, out="__i").withColumn("__v", F.col(value).cast("double"))
    own = F.floor((F.col("__i") - 1) / block)
    late = (F.col("__i") - 1) % block >= block - (window - 1)
    blocks = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    spread = ranked.select("*", F.posexplode(blocks).alias("__copy", "__block"))
    w = Window.partitionBy("__block").orderBy("__i").rowsBetween(-(window - 1), 0)
    mean = F.when(F.col("__i") >= window, F.sum("__v").over(w) / F.lit(float(window)))
    return spread.withColumn(out, mean).where("__copy = 0").drop("__copy", "__block", "__v").withColumnRenamed("__i", "position")


def metric_unpivot(metrics: DataFrame, id_cols: Sequence[str], names: Sequence[str] = COMPARISON_METRICS) -> DataFrame:
    """Scenario x metric long table (one bar per pair)."""
    sel = metrics.select(*id_cols, *[F.col(n).cast("double").alias(n) for n in names])
    return sel.unpivot(list(id_cols), list(names), "metric", "value")
