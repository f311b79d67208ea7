"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.session import staged

#: Word characters are everything but space and the five ASCII controls 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def text_key(c: Column | str) -> Column:
    """128-bit content key: equal texts (null counts as empty) share it."""
    return F.unhex(F.md5(text_or_empty(c).cast("binary")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Largest bit filter: 2**26 bits, 8 MB. With more keys it passes more rows, never fewer.
FILTER_BITS = 26


class BitFilter:
    """Which 64-bit hashes may be among given ones; bounded in size, without false negatives."""

    def __init__(self, hashes: DataFrame, bits: int = FILTER_BITS):
        """``hashes`` has one long column; its bits are or-ed in Spark, at most 2**20 words reach the driver."""
        low = hashes.toDF("__h").select(F.col("__h").bitwiseAND(F.lit((1 << bits) - 1)).alias("__h"))
        words = low.select(F.shiftright("__h", 6).alias("word"), F.expr("shiftleft(1L, cast(__h & 63 as int))").alias("bit"))
        got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
        table_ = np.zeros(1 << (bits - 6), np.int64)
        table_[got["word"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64)
        self.bits, self.shared = bits, hashes.sparkSession.sparkContext.broadcast(table_)

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared}

    def test(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.int64) & ((1 << self.bits) - 1)
        return (self.shared.value[at >> 6] >> (at & 63)) & 1 == 1

    def column(self, h: Column) -> Column:
        test = self.test

        @F.pandas_udf(T.BooleanType())
        def maybe(h: pd.Series) -> pd.Series:
            return pd.Series(test(h.to_numpy(np.int64)))

        return maybe(h)


def filter_for(keys: DataFrame) -> BitFilter:
    """A filter for the texts whose keys (column tkey) are given, sized by their number."""
    return BitFilter(keys.select(F.xxhash64("tkey")), min(FILTER_BITS, max(12, (16 * max(1, keys.count())).bit_length())))


def texts_of(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (with a column tkey, unique) joined to one text per key.

    A bit filter drops most rows of other texts before the shuffle; repeated texts are reduced to
    one before it too.
    """
    text = documents.select(text_key("text").alias("tkey"), text_or_empty("text").alias("text"))
    near = text.where(filter_for(keys).column(F.xxhash64("tkey"))).dropDuplicates(["tkey"])
    return near.join(keys, "tkey")


def without_texts(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``documents`` whose text is not among ``keys`` (column tkey); only doubtful rows are shuffled."""
    keyed = documents.withColumn("__tkey", text_key("text"))
    maybe = filter_for(keys).column(F.xxhash64("__tkey"))
    doubt = keyed.where(maybe).join(keys.select(F.col("tkey").alias("__tkey")), "__tkey", "left_anti")
    return keyed.where(~maybe).unionByName(doubt).drop("__tkey")


#: Rows of a small table that may be broadcast; each is a few hundred bytes.
BROADCAST_ROWS = 20_000
_SALTS = 32


def beside(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``small`` (unique ``key``, a few numbers a row), however unevenly the keys are spread.

    A counted small table is broadcast; a larger one is copied to salted keys, so that one key's rows go to many tasks.
    """
    small = staged(small, "small")
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if kind in ("bigint", "double", "string")]), F.lit(_SALTS)).cast("int"))
    return salted.join(small.withColumn("__salt", salts), [key, "__salt"], "left").drop("__salt")


def on_columns(documents: DataFrame, needed: tuple[str, ...], step) -> DataFrame:
    """``step`` applied to ``documents`` with only ``needed`` under their names; then all names as they were.

    Other columns ride along under names that nothing clashes with, whatever they are called. ``step`` must return
    all columns it gets; it may add some, which go.
    """
    names = documents.columns
    inner = [c if c in needed and names.index(c) == i else f"__c{i}" for i, c in enumerate(names)]
    out = step(documents.toDF(*inner)).select(*inner)
    return out.toDF(*names)
