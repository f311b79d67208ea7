"""Experiments: scenario table, ablation, best scenario, bootstrap interval."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefold.operators import metrics as M
from rarefold.operators.model import PROBA
from rarefold.session import staged

log = logging.getLogger(__name__)

# Column order of the ablation report (fixed values)
REPORT_HEAD = ("scenario", "n_train_samples", "n_positive_train", "auc_pr", "auc_roc", "f1", "precision", "recall", "mcc")

AS_IS, SMOTE, ALL_SYNTHETIC, SELECTED = "as_is", "smote", "all_synthetic", "selected"


def scenario_table(base: DataFrame, smote_rows: DataFrame | None = None, pool: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """One long training table with a ``scenario`` column (J2 per scenario).

    An empty selection falls back to the as-is rows (with a warning)."""
    parts = [base.withColumn("scenario", F.lit(AS_IS))]
    if smote_rows is not None:
        parts.append(base.unionByName(smote_rows, allowMissingColumns=True).withColumn("scenario", F.lit(SMOTE)))
    if pool is not None:
        parts.append(base.unionByName(pool, allowMissingColumns=True).withColumn("scenario", F.lit(ALL_SYNTHETIC)))
    if selected is not None:
        if selected.isEmpty():
            log.warning("empty selection: the selected scenario uses the original rows only")
            parts.append(base.withColumn("scenario", F.lit(SELECTED)))
        else:
            parts.append(base.unionByName(selected, allowMissingColumns=True).withColumn("scenario", F.lit(SELECTED)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def report_columns(cols: Sequence[str]) -> list[str]:
    """Scenario, sizes, main metrics, recall_at_fpr*, then the rest."""
    first = [c for c in REPORT_HEAD if c in cols]
    fpr = sorted(c for c in cols if c.startswith("recall_at_fpr"))
    return first + fpr + [c for c in cols if c not in first and c not in fpr]


def run_ablation(
    scenarios: Mapping[str, DataFrame],
    test: DataFrame,
    features: Sequence[str],
    target: str,
    train: Callable[[DataFrame], object],
    threshold: float = 0.5,
    threads: int = 4,
) -> DataFrame:
    """Per scenario, ``train(rows)`` -> classifier (run from a small thread pool, as a
    fit is a chain of small jobs); score the shared test set;
    all scored rows go through one grouped metric job (I8 by scenario)."""
    spark = test.sparkSession
    scored, sizes = None, []
    with ThreadPoolExecutor(max_workers=threads) as ex:
        fitted = list(ex.map(train, scenarios.values()))
    for (name, rows), clf in zip(scenarios.items(), fitted, strict=True):
        s = clf.predict_proba(test).select(F.col(target).alias("__y"), F.col(PROBA).alias("__s")).withColumn("scenario", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
        c = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("p")).first()
        sizes.append((name, int(c["n"]), int(c["p"])))
    met = M.metric_row(scored, "__y", "__s", threshold, group_cols=["scenario"], flat=True)
    size_df = spark.createDataFrame(sizes, "scenario string, n_train_samples long, n_positive_train long")
    out = met.join(size_df, "scenario")
    return out.select(*report_columns(out.columns))


def best_scenario(ablation: DataFrame, metric: str = "auc_pr", key: str = "scenario") -> DataFrame:
    """The row with the highest metric (ties: smallest key)."""
    return ablation.orderBy(F.desc(metric), F.asc(key)).limit(1)


# Poisson(1) distribution function at 0, 1, 2, ... (fixed values): a draw u counts as many as it passes
POISSON_CDF = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)
_PRIME = 2147483647
POISSON_CUTS = tuple(int(c * _PRIME) for c in POISSON_CDF)


def _weights(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row x replicate Poisson(1) weights from a row hash below 2^31 - 1, in 64-bit integer arithmetic that any SQL engine has."""
    h, b = h[:, None], b[None, :] + 1
    x = (h + b * 1000003) % _PRIME
    x = x * x % _PRIME
    x = (x * 48271 + b * 7919 + h) % _PRIME
    x = x * x % _PRIME
    return np.searchsorted(np.array(POISSON_CUTS), (x * 16807 + h) % _PRIME, "right").astype(np.int64)


def sql_weight(h: str, b: str) -> str:
    """The same weight as a DuckDB expression; ``h`` and ``b`` are column names."""
    p = _PRIME
    one = f"(({h} + ({b} + 1) * 1000003) % {p})"
    two = f"(({one} * {one} % {p} * 48271 + ({b} + 1) * 7919 + {h}) % {p})"
    x = f"(({two} * {two} % {p} * 16807 + {h}) % {p})"
    return f"(select count(*) from (values {', '.join(f'({c})' for c in POISSON_CUTS)}) cuts(c) where c <= {x})"


#: rows that one group of the bootstrap holds
RUN_ROWS = 8192


def _replicate_sums(pdf: pd.DataFrame, n_bootstrap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(replicates, running weights of positives, running weights of all) of a run of rows, a few replicates at a time."""
    h, y = pdf["h"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
    step = max(1, 2_000_000 // max(1, len(h)))
    for at in range(0, n_bootstrap, step):
        b = np.arange(at, min(n_bootstrap, at + step))
        w = _weights(h, b)
        yield b, (w * y[:, None]).cumsum(axis=0), w.cumsum(axis=0)


def bootstrap_metrics(
    df: DataFrame,
    label: str,
    score: str,
    id_col: str,
    n_bootstrap: int = 1000,
    seed: int = 42,
    threshold: float = 0.5,
    fpr_targets: Sequence[float] = M.DEFAULT_FPR_TARGETS,
) -> DataFrame:
    """(b, auc_roc, auc_pr, recall_at_fpr_*, precision, recall, f1, mcc) for each replicate.

    Poisson bootstrap: each row counts Poisson(1) times in each replicate, independently, which is the limit of drawing n rows
    with replacement. Weights are computed in place from a hash of the id; rows are range-partitioned by (score, hash) once and each
    range is cut into runs of RUN_ROWS rows, so what a task holds depends on neither the rows nor the partitions. A
    run gives one running total per replicate, and no (replicate, row) table exists. Equal scores that lie in several
    runs are put together at the end. A replicate without one of the classes has null ranking metrics.
    """
    spark = df.sparkSession
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("boot"), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("bigint")
    rows = M._scored(df, label, score, "raise").select(F.col(label).cast("long").alias("y"), F.col(score).cast("double").alias("s"), (key % _PRIME).alias("h"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = staged(rows.repartitionByRange(ranges, F.desc("s"), F.col("h")).withColumn("pid", F.spark_partition_id()), "bootstrap")
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("s"), "h", "y"))  # rows that tie here are equal
    run = F.floor((inside - 1) / F.lit(RUN_ROWS)).cast("long")
    placed = staged(cut.withColumn("pid", F.shiftleft(F.col("pid").cast("long"), 32) + run), "bootstrap-runs")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"pid": pdf["pid"].iloc[0], "b": b, "pos": p[-1], "cnt": c[-1]}) for b, p, c in _replicate_sums(pdf, n_bootstrap)]
        return pd.concat(parts)

    sums = placed.groupBy("pid").applyInPandas(totals, "pid long, b long, pos long, cnt long")
    before = Window.partitionBy("b").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("b")
    zero = F.lit(0).cast("long")
    offs = sums.select(
        "pid", "b", F.coalesce(F.sum("pos").over(before), zero).alias("pos0"), F.coalesce(F.sum("cnt").over(before), zero).alias("cnt0"),
        F.sum("pos").over(every).alias("P"), (F.sum("cnt").over(every) - F.sum("pos").over(every)).alias("N"),
    )
    names = [M.fpr_key(t) for t in fpr_targets]
    hits = [f"h{i}" for i in range(len(names))]

    def measure(rows_: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        rows_, offsets = rows_.sort_values("s", ascending=False, kind="stable"), offsets.sort_values("b")
        s = rows_["s"].to_numpy()
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # ends of runs of equal scores
        over = int(np.searchsorted(-s, -threshold, "right"))
        out = []
        for b, p, c in _replicate_sums(rows_, n_bootstrap):
            o = offsets.iloc[b[0] : b[-1] + 1]
            P, N = o["P"].to_numpy(), o["N"].to_numpy()
            tp, pp = (x[over - 1] if over else np.zeros(len(b), np.int64) for x in (p, c))
            cp, cc = p[last] + o["pos0"].to_numpy(), c[last] + o["cnt0"].to_numpy()
            pos, cnt = np.diff(cp, axis=0, prepend=o["pos0"].to_numpy()[None]), np.diff(cc, axis=0, prepend=o["cnt0"].to_numpy()[None])
            edge = [0] if len(last) == 1 else [0, len(last) - 1]
            inner = slice(1, len(last) - 1)
            one = pd.DataFrame({"b": b, "s": np.nan, "pos": 0, "cnt": 0, "cp": 0, "cc": 0, "P": P, "N": N, "tp": tp, "pp": pp})
            with np.errstate(invalid="ignore", divide="ignore"):
                one["ap"] = np.nan_to_num(pos[inner] * (cp[inner] / cc[inner])).sum(axis=0)
            one["auc"] = ((cnt[inner] - pos[inner]) * (cp[inner] - pos[inner] / 2)).sum(axis=0)
            for k, t in zip(hits, fpr_targets, strict=True):
                one[k] = np.where(cc[inner] - cp[inner] <= t * N, cp[inner], 0).max(axis=0, initial=0)
            out.append(one)
            for e in edge:
                part = one.assign(s=s[last[e]], pos=pos[e], cnt=cnt[e], cp=cp[e], cc=cc[e], tp=0, pp=0, ap=0.0, auc=0.0)
                out.append(part.assign(**dict.fromkeys(hits, 0)))
        return pd.concat(out)

    schema = "b long, s double, pos long, cnt long, cp long, cc long, P long, N long, tp long, pp long, ap double, auc double" + "".join(f", {k} long" for k in hits)
    parts = placed.groupBy("pid").cogroup(offs.groupBy("pid")).applyInPandas(measure, schema)
    # equal scores at the edges of ranges: one group each
    whole = parts.groupBy("b", "s").agg(
        F.sum("pos").alias("pos"), F.sum("cnt").alias("cnt"), F.max("cp").alias("cp"), F.max("cc").alias("cc"), F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("ap").alias("ap"), F.sum("auc").alias("auc"), *[F.max(k).alias(k) for k in hits],
    )
    edge = ~F.isnan("s")
    ap = F.col("ap") + F.when(edge & (F.col("cc") > 0), F.col("pos") * (F.col("cp") / F.col("cc"))).otherwise(0.0)
    auc = F.col("auc") + F.when(edge, (F.col("cnt") - F.col("pos")) * (F.col("cp") - F.col("pos") / 2.0)).otherwise(0.0)
    hit = [F.max(F.greatest(F.col(k), F.when(edge & (F.col("cc") - F.col("cp") <= F.lit(t) * F.col("N")), F.col("cp")).otherwise(0))).alias(k) for k, t in zip(hits, fpr_targets, strict=True)]
    per = whole.groupBy("b").agg(F.first("P").alias("P"), F.first("N").alias("N"), F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum(ap).alias("ap"), F.sum(auc).alias("auc"), *hit)
    P, N = F.nullif(F.col("P").cast("double"), F.lit(0.0)), F.nullif(F.col("N").cast("double"), F.lit(0.0))
    both = N.isNotNull()
    cm = per.select(
        "b", (F.col("auc") / (P * N)).alias("auc_roc"), (F.col("ap") / P).alias("auc_pr"), *[F.when(both, F.col(k) / P).alias(n) for k, n in zip(hits, names, strict=True)],
        "tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("pp") + F.col("tp")).alias("tn"),
    )
    return M.with_threshold_metrics(cm)


def bootstrap_ci(
    df: DataFrame,
    label: str,
    score: str,
    id_col: str,
    metric: str | Callable[[DataFrame], Column] = "auc_pr",
    n_bootstrap: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
    threshold: float = 0.5,
) -> DataFrame:
    """E5: mean and (1 +- ci)/2 quantiles (linear interpolation) of a metric over the replicates of ``bootstrap_metrics``.

    ``metric`` is one of its columns (a recall at any FPR included, e.g. ``recall_at_fpr_5e-02``) or a function of the
    replicate table that gives a column. Undefined replicates are left out.
    """
    targets = tuple(dict.fromkeys((*M.DEFAULT_FPR_TARGETS, *([float(metric.removeprefix("recall_at_fpr_"))] if isinstance(metric, str) and metric.startswith("recall_at_fpr_") else []))))
    per = bootstrap_metrics(df, label, score, id_col, n_bootstrap, seed, threshold, targets)
    per = per.select((metric(per) if callable(metric) else F.col(f"`{metric}`")).alias("m"))
    a = (1 - ci) / 2
    return per.agg(F.avg("m").alias("mean"), F.percentile("m", a).alias("lower"), F.percentile("m", 1 - a).alias("upper"))
