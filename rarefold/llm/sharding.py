"""Contiguous byte-balanced shards from a global prefix sum.

The order is the one in which the rows lie in the input splits. Each split is
one unit: its byte and row totals are one small aggregate, the running totals of
the splits before it come from that aggregate, and only then does each split run
its own prefix sum. No row is sorted globally, so a key, source or text that holds
a third of the rows cannot overload a task. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefold.llm.common import staged, text_or_empty

#: Splits whose totals are summed together before the single small window over groups of splits.
FANOUT = 1024


def _before(totals: DataFrame) -> DataFrame:
    """Bytes and rows in the splits before each split.

    Two levels: within groups of ``FANOUT`` splits, then over the groups; the last window
    sees one row per FANOUT splits.
    """
    part = totals.withColumn("grp", F.floor(F.col("split") / FANOUT))
    up_to = Window.partitionBy("grp").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inner = part.select(
        "grp",
        "split",
        F.coalesce(F.sum("split_bytes").over(up_to), F.lit(0)).alias("in_bytes"),
        F.coalesce(F.sum("split_rows").over(up_to), F.lit(0)).alias("in_rows"),
    )
    groups = part.groupBy("grp").agg(F.sum("split_bytes").alias("b"), F.sum("split_rows").alias("r"))
    over = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "grp",
        F.coalesce(F.sum("b").over(over), F.lit(0)).alias("grp_bytes"),
        F.coalesce(F.sum("r").over(over), F.lit(0)).alias("grp_rows"),
    )
    return inner.join(groups, "grp").select(
        "split",
        (F.col("in_bytes") + F.col("grp_bytes")).alias("bytes_before"),
        (F.col("in_rows") + F.col("grp_rows")).alias("rows_before"),
    )


def shard_by_bytes(rows: DataFrame, size: Column, shards: int) -> DataFrame:
    """``rows`` plus shard (int, 0 .. shards-1) and slot (long, gapless from 0 in each shard).

    Row i belongs to the shard whose equal target interval holds the middle of its
    bytes, so shards are runs of consecutive rows and each is off its target by at
    most one row at either end. ``rows`` should be narrow: it is written once, as the
    totals and the prefix sums must see the same splits.

    Sizes are not negative; a null size counts as 0. Repeated rows are rows of their own. Empty input
    gives an empty result. If all sizes are 0 all rows go to shard 0. Column names that
    start with ``__`` are reserved.
    """
    placed = staged(
        rows.withColumns(
            {
                "__size": F.coalesce(size.cast("long"), F.lit(0)),
                "__split": F.spark_partition_id(),
                "__at": F.monotonically_increasing_id(),
            }
        ),
        "shard-rows",
    )
    totals = placed.groupBy(F.col("__split").alias("split")).agg(
        F.sum("__size").alias("split_bytes"), F.count(F.lit(1)).alias("split_rows")
    )
    before = _before(totals).withColumnRenamed("split", "__split")
    grand = totals.agg(F.coalesce(F.sum("split_bytes"), F.lit(0)).alias("__total"))
    run = Window.partitionBy("__split").orderBy("__at")
    summed = (
        placed.join(before, "__split")
        .withColumn("__end", F.col("bytes_before") + F.sum("__size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__row", F.col("rows_before") + F.row_number().over(run) - 1)
        .crossJoin(F.broadcast(grand))  # one row
    )
    middle = F.col("__end").cast("decimal(38,0)") * 2 - F.col("__size")
    shard = F.when(F.col("__total") == 0, 0).otherwise(
        F.least(F.floor(middle * shards / (F.col("__total").cast("decimal(20,0)") * 2)), F.lit(shards - 1))
    )
    cut = staged(summed.withColumn("shard", shard.cast("int")).drop("bytes_before", "rows_before", "__end", "__total", "__at", "__split", "__size"), "shard-cut")
    first = cut.groupBy("shard").agg(F.min("__row").alias("__first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("__row") - F.col("__first")).drop("__row", "__first")


def shard_documents(documents: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``documents``.

    Size is the UTF-8 length of the text plus ``overhead`` bytes of framing; a null
    text counts as empty, a null doc_id is kept as null. Other columns are not read.
    """
    text = text_or_empty("text")
    narrow = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard_by_bytes(narrow, F.col("size"), shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
