"""Quality rules: text statistics and robust multivariate outliers.

Statistics come from array functions inside the scan (no row per word, no shuffle of
text). The verdict is a minimum-covariance-determinant (MCD) estimate per language
and source: concentration steps over the small statistics table, several
deterministic starts, the smallest determinant wins, then one reweighting. A row is rejected
if its Mahalanobis distance passes a chi-square cut. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import WHITE, beside, on_columns, staged, text_or_empty

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
_WS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the base rules and of the MCD verdict."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: share of a group's rows that the estimate is concentrated on
    support: float = 0.75
    steps: int = 5
    #: groups with fewer rows use the estimate over all rows
    min_group: int = 200
    #: squared distance beyond which a row is rejected; chi-square, 4 degrees, p = 1e-9
    cut: float = 47.0
    #: standard deviation that every transformed statistic has at least
    floor: float = 0.25


def with_statistics(documents: DataFrame) -> DataFrame:
    """``documents`` plus the five statistics (long), null text counting as empty.

    An empty or all-white text has zeros throughout. Texts are used whole; a row with repeated
    8-word windows sorts its window hashes, other rows only hash them. Columns named ``__*``
    are reserved; existing columns with a statistic's name are replaced.
    """
    d = documents.drop(*STATS)
    d = d.withColumn("__text", text_or_empty("text"))
    d = d.withColumn("__words", F.filter(F.split("__text", _WS), lambda w: w != ""))
    # 64-bit hashes per word, then per window: only equality within one text matters
    d = d.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("word_chars", F.char_length(F.array_join("__words", "")).cast("long"))
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    at = lambda i, k: F.get(F.col("__hash"), i + k)
    d = d.withColumn("__grams", F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    d = d.withColumn("__repeats", F.size("__grams") - F.size(F.array_distinct("__grams")))
    ranked = F.when(F.col("__repeats") > 0, F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    d = d.drop("__hash", "__words").withColumn("__ranked", ranked)
    same = lambda x, k: F.get("__ranked", k)["g"].eqNullSafe(x["g"])
    d = d.withColumn("__starts", F.array_sort(F.transform(F.filter("__ranked", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - s, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    d = d.withColumn("n_symbols", F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"))
    lines = F.filter(F.split("__text", "\n"), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0)
    d = d.withColumn("__lines", lines)
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return d.drop("__text", "__grams", "__repeats", "__ranked", "__starts", "__lines")


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def _vector() -> list[Column]:
    """Transformed statistics, each on a scale where clean prose spreads by a few tenths."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.col("word_chars") / n + F.lit(0.5)) * 2,
        F.asinh(F.lit(20.0) * F.col("n_symbols") / n),
        F.asinh(F.lit(50.0) * F.col("n_dup_lines") / n),
        F.asinh(F.lit(5.0) * F.col("n_repeat_words") / n),
    ]


_D = 4
_X = [f"__x{i}" for i in range(_D)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]
_STARTS = 3


def _moments(rows: DataFrame, weight: Column, tag: str) -> list[Column]:
    """Aggregates of one start: weight, sums and sums of products."""
    x = lambda i: F.col(_X[i])
    return (
        [F.sum(weight).alias(f"{tag}w")]
        + [F.sum(weight * x(i)).alias(f"{tag}s{i}") for i in range(_D)]
        + [F.sum(weight * x(i) * x(j)).alias(f"{tag}q{i}{j}") for i, j in _PAIRS]
    )


def _factored(sums: DataFrame, tag: str, floor: float, scale: float) -> DataFrame:
    """From moments to mean (m), Cholesky factor (l) and log determinant (det) by closed formulas."""
    w = F.greatest(F.col(f"{tag}w"), F.lit(1e-9))
    out = sums.withColumns({f"{tag}m{i}": F.col(f"{tag}s{i}") / w for i in range(_D)})
    cov = {}
    for i, j in _PAIRS:
        c = (F.col(f"{tag}q{i}{j}") / w - F.col(f"{tag}m{i}") * F.col(f"{tag}m{j}")) * scale
        cov[f"{tag}c{i}{j}"] = F.greatest(c, F.lit(0.0)) + floor * floor if i == j else c
    out = out.withColumns(cov)
    for j in range(_D):
        rest = sum((F.col(f"{tag}l{j}{k}") * F.col(f"{tag}l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"{tag}l{j}{j}", F.sqrt(F.greatest(F.col(f"{tag}c{j}{j}") - rest, F.lit(1e-6))))
        for i in range(j + 1, _D):
            dot = sum((F.col(f"{tag}l{i}{k}") * F.col(f"{tag}l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"{tag}l{i}{j}", (F.col(f"{tag}c{i}{j}") - dot) / F.col(f"{tag}l{j}{j}"))
    det = sum((F.log(F.col(f"{tag}l{i}{i}")) for i in range(_D)), F.lit(0.0))
    keep = ["__grp", f"{tag}det"] + [f"{tag}m{i}" for i in range(_D)] + [f"{tag}l{i}{j}" for i, j in _PAIRS]
    return out.withColumn(f"{tag}det", det).select(*keep)


def _distance(rows: DataFrame, tag: str, out: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution on the factor's columns."""
    for i in range(_D):
        dot = sum((F.col(f"{tag}l{i}{k}") * F.col(f"{tag}z{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"{tag}z{i}", (F.col(_X[i]) - F.col(f"{tag}m{i}") - dot) / F.col(f"{tag}l{i}{i}"))
    total = sum((F.col(f"{tag}z{i}") * F.col(f"{tag}z{i}") for i in range(_D)), F.lit(0.0))
    return rows.withColumn(out, total).drop(*[f"{tag}z{i}" for i in range(_D)])


def _starting_weights(stats: DataFrame) -> DataFrame:
    """Three deterministic starts: sphered median/MAD, distance of tanh scores, ranks of the first statistic."""
    med = stats.groupBy("__grp").agg(*[F.percentile_approx(x, 0.5, 2000).alias(f"{x}md") for x in _X])
    dev = beside(stats, med, "__grp").withColumns({f"{x}ad": F.abs(F.col(x) - F.col(f"{x}md")) for x in _X})
    mad = dev.groupBy("__grp").agg(*[F.percentile_approx(f"{x}ad", 0.5, 2000).alias(f"{x}mad") for x in _X])
    scored = beside(dev, mad, "__grp")
    r = {x: F.col(f"{x}ad") / F.greatest(F.col(f"{x}mad") * 1.4826, F.lit(0.1)) for x in _X}
    return scored.withColumns(
        {
            "__d0": sum((r[x] * r[x] for x in _X), F.lit(0.0)),
            "__d1": sum((F.tanh(r[x]) for x in _X), F.lit(0.0)),
            "__d2": r[_X[0]],
        }
    ).select("__grp", *_X, *[f"__d{s}" for s in range(_STARTS)])


def _concentrate(rows: DataFrame, rules: QualityRules) -> DataFrame:
    """One step: weight 1 for the closest ``support`` of each group under each start, then new moments."""
    cuts = rows.groupBy("__grp").agg(*[F.percentile_approx(f"__d{s}", rules.support, 2000).alias(f"__h{s}") for s in range(_STARTS)])
    joined = beside(rows, cuts, "__grp")
    aggs = []
    for s in range(_STARTS):
        aggs += _moments(joined, (F.col(f"__d{s}") <= F.col(f"__h{s}")).cast("double"), f"__{s}")
    return joined.groupBy("__grp").agg(*aggs)


#: Makes the covariance of the closest three quarters of a normal sample unbiased (4 dimensions, support 0.75).
_CONSISTENT = 1.6


def fit_mcd(stats: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per group: mean and factor of the reweighted MCD estimate.

    ``stats`` holds ``__grp`` and the transformed vector; its size is a few numbers a row, so
    every step is one map-side-combined aggregate per group whatever share of the rows a
    group holds.
    """
    rows = _starting_weights(stats)
    for _ in range(rules.steps):
        sums = staged(_concentrate(rows, rules), "mcd-step")
        model = None
        for s in range(_STARTS):
            one = _factored(sums, f"__{s}", rules.floor, _CONSISTENT)
            model = one if model is None else model.join(one, "__grp")
        model = staged(model, "mcd-model")
        rows = beside(stats, model, "__grp")
        for s in range(_STARTS):
            rows = _distance(rows, f"__{s}", f"__d{s}")
        rows = rows.select("__grp", *_X, *[f"__d{s}" for s in range(_STARTS)])
    best = F.least(*[F.col(f"__{s}det") for s in range(_STARTS)])
    pick = lambda name: F.coalesce(*[F.when(F.col(f"__{s}det") == best, F.col(f"__{s}{name}")) for s in range(_STARTS)])
    names = [f"m{i}" for i in range(_D)] + [f"l{i}{j}" for i, j in _PAIRS]
    chosen = model.select("__grp", *[pick(n).alias(f"__r{n}") for n in names])
    near = _distance(beside(stats, chosen, "__grp"), "__r", "__d").where(F.col("__d") <= 11.14)  # chi-square, 4 degrees, 0.975
    again = near.groupBy("__grp").agg(*_moments(near, F.lit(1.0), "__f"))
    return staged(_factored(again, "__f", rules.floor, 1.0), "mcd-final")


def judge(documents: DataFrame, rules: QualityRules = QualityRules(), drop_text: bool = False) -> DataFrame:
    """``documents`` plus the statistics, base_failed, distance and kept.

    A row is kept if the base rules pass and its squared distance from its language
    and source's estimate is at most ``rules.cut``. The estimate is fitted on rows that pass the
    base rules; a null language or source is a value of its own. Groups of fewer than
    ``min_group`` such rows, and groups in which none passes, use the estimate over all
    rows. If no row passes the base rules nothing is kept and distance is null. Repeated rows
    count each; other columns pass through. Statistics are written once and reread, without
    the text if ``drop_text``.
    """
    measured = with_statistics(documents).withColumn("base_failed", base_failed(rules))
    kept = staged(measured.drop("text") if drop_text else measured, "quality-stats")
    d = kept.withColumns(dict(zip(_X, _vector(), strict=True)))
    d = d.withColumn("__own", F.struct(F.coalesce("lang", F.lit("\x00")).alias("l"), F.coalesce("source", F.lit("\x00")).alias("s")))
    counts = d.where(~F.col("base_failed")).groupBy("__own").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= rules.min_group)
    good = d.where(~F.col("base_failed")).select("__own", *_X)
    counts = staged(counts, "mcd-groups")
    own = beside(good, counts, "__own").where(F.col("__n").isNotNull()).select(F.struct("__own.l", "__own.s", F.lit(True).alias("own")).alias("__grp"), *_X)
    whole = good.select(F.struct(F.lit("").alias("l"), F.lit("").alias("s"), F.lit(False).alias("own")).alias("__grp"), *_X)
    model = fit_mcd(own.unionByName(whole), rules)
    d = beside(d, counts, "__own")
    key = F.when(F.col("__n").isNotNull(), F.struct("__own.l", "__own.s", F.lit(True).alias("own"))).otherwise(
        F.struct(F.lit("").alias("l"), F.lit("").alias("s"), F.lit(False).alias("own"))
    )
    d = beside(d.withColumn("__grp", key), model, "__grp")
    d = _distance(d, "__f", "distance")
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= rules.cut, F.lit(False))
    return d.select(*[F.col(f"`{c}`") for c in kept.columns], "distance", verdict.alias("kept"))


def keep_good(documents: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, with the columns they have."""
    return on_columns(documents, ("text", "lang", "source"), lambda d: judge(d, rules).where("kept"))
