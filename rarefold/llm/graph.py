"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import staged


def _mark(edges: DataFrame):
    """Count and an order-free checksum, to see whether a step changed the edge set."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b, both long); comp is the least node reachable.

    Each step keeps at most as many edges as it gets, so a group of n nodes never turns into
    pairs; minima are combined before the shuffle, and each step is written to the shared folder.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = staged(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    members = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    return members.unionByName(members.select(F.col("comp").alias("node"), "comp").distinct())
