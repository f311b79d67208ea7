"""Exact quantiles (NumPy's linear interpolation) of many columns at once.

Spark's exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer. Here the work stays distributed:

1. one pass: count and ``percentile_approx`` cut points for every column;
2. each column is range-bucketed on its own cut points (a value filling two or
   more cut intervals gets a bucket to itself); per (column, bucket) counts
   come back to the driver (columns x buckets rows);
3. only the bucket holding each wanted order statistic is scanned again,
   grouped to distinct values and ranked inside that bucket, if it has at most ``SMALL`` rows;
4. a larger bucket is cut again in the same way, until it is small or holds one value.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def default_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(4 * parts, 100_000))


def _splits(cuts) -> list[float]:
    """Bucket borders from cut points; a value that fills several cut intervals gets a bucket of its own."""
    finite = [c for c in (cuts or []) if c is not None and math.isfinite(c)]
    heavy = [v for v, k in Counter(finite).items() if k >= 2]
    pts = set(finite) | {math.nextafter(v, math.inf) for v in heavy}
    splits = [-math.inf, *sorted(pts), math.inf]
    return splits if len(splits) > 2 else [-math.inf, 0.0, math.inf]


#: Rows of a bucket that one task may rank.
SMALL = 1_000_000
#: Cuts of a bucket that is larger.
FINER = 200


def _order_statistic(values: DataFrame, rank: int) -> float:
    """The value of 0-based ``rank`` among the rows of ``values`` (v, no nulls), by narrowing its bucket.

    Every pass leaves about 1 / ``FINER`` of the rows; a value that fills two cut intervals or more is a bucket of its own and
    ends the search. At most 2 ``FINER`` counts reach the driver.
    """
    probs = [i / FINER for i in range(1, FINER)]
    while True:
        s = values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", probs, 50 * FINER).alias("cuts")).first()
        if s["low"] == s["high"]:
            return s["low"]
        if s["n"] <= SMALL:
            w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # at most SMALL values
            ranked = values.groupBy("v").count().withColumn("upto", F.sum("count").over(w))
            return ranked.where(F.col("upto") > rank).agg(F.min("v")).first()[0]
        bucketed = Bucketizer(splits=_splits(s["cuts"]), inputCol="v", outputCol="b").transform(values)
        before = 0
        for b, n in sorted((x["b"], x["count"]) for x in bucketed.groupBy("b").count().collect()):
            if rank < before + n:
                break
            before += n
        values, rank = bucketed.where(F.col("b") == b).select("v"), rank - before


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5, n_buckets: int | None = None) -> dict[str, float | None]:
    cols = list(cols)
    if not cols:
        return {}
    nb = n_buckets or max(8, min(default_buckets(df), 200_000 // len(cols)))
    probs = [i / nb for i in range(1, nb)]
    acc = max(10_000, 10 * nb)
    clean = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    stats = clean.agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))],
        *[F.percentile_approx(f"c{i}", probs, acc).alias(f"p{i}") for i in range(len(cols))],
    ).first()
    splits = [_splits(stats[f"p{i}"]) for i in range(len(cols))]
    bz = Bucketizer(
        splitsArray=splits,
        inputCols=[f"z{i}" for i in range(len(cols))],
        outputCols=[f"b{i}" for i in range(len(cols))],
        handleInvalid="keep",
    )
    zeroed = clean.select(*[F.col(f"c{i}") for i in range(len(cols))], *[F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias(f"z{i}") for i in range(len(cols))])
    bucketed = bz.transform(zeroed)
    long = bucketed.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"b{i}").cast("int").alias("b"), F.col(f"c{i}").alias("v")) for i in range(len(cols))])
        ).alias("r")
    ).select("r.k", "r.b", "r.v").where(F.col("v").isNotNull())
    counts = long.groupBy("k", "b").count().collect()  # columns x buckets rows, bounded
    per = {}
    for r in counts:
        per.setdefault(r["k"], []).append((r["b"], r["count"]))
    targets = []  # (k, b, local 0-based rank, tag)
    got, need = {}, {}
    for i in range(len(cols)):
        n = stats[f"n{i}"]
        if not n:
            continue
        h = (n - 1) * q
        k1, k2 = math.floor(h), math.ceil(h)
        need[i] = (h, k1, k2)
        off = 0
        for b, c in sorted(per.get(i, [])):
            for tag, k in (("lo", k1), ("hi", k2)):
                if off <= k < off + c <= off + SMALL:
                    targets.append((i, b, k - off, tag))
                elif off <= k < off + c:
                    got[i, tag] = got[i, "lo"] if tag == "hi" and k2 == k1 else _order_statistic(long.where((F.col("k") == i) & (F.col("b") == b)).select("v"), k - off)
            off += c
    if not need:
        return {c: None for c in cols}
    if targets:
        got |= _ranked(df.sparkSession, long, targets)
    out: dict[str, float | None] = {}
    for i, c in enumerate(cols):
        if i not in need:
            out[c] = None
            continue
        h, k1, _ = need[i]
        lo, hi = got[(i, "lo")], got[(i, "hi")]
        out[c] = lo + (h - k1) * (hi - lo)
    return out


def _ranked(spark, long: DataFrame, targets: list[tuple]) -> dict[tuple[int, str], float]:
    """(column, tag) -> value for targets in small buckets, each ranked in one task."""
    tdf = spark.createDataFrame(targets, "k int, b int, r long, tag string")
    keys = spark.createDataFrame(sorted({(t[0], t[1]) for t in targets}), "k int, b int")
    # at most two (column, bucket) pairs per column: bounded broadcast
    sub = long.join(F.broadcast(keys), ["k", "b"]).groupBy("k", "b", "v").count()
    w = Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sub.withColumn("cum", F.sum("count").over(w))
    hit = ranked.join(F.broadcast(tdf), ["k", "b"]).where((F.col("cum") - F.col("count") <= F.col("r")) & (F.col("r") < F.col("cum")))
    return {(r["k"], r["tag"]): r["v"] for r in hit.select("k", "tag", "v").collect()}
