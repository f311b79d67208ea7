import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from rarefold.llm.sharding import shard_by_bytes, shard_documents


def test_every_row_once_and_balanced(awkward):
    rows = shard_documents(awkward, shards=7).collect()
    src = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in awkward.collect()]
    assert sorted(map(repr, src)) == sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 7
        by[r.shard].append(r)
    total, most = sum(s[1] for s in src), max(s[1] for s in src)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / 7 + most


def test_against_one_pass(spark):
    # one split: the shards must be those of a plain loop over the rows
    df = spark.range(0, 1000, 1, 1).select("id", ((F.col("id") * 37) % 101).alias("b"))
    got = {r.id: r.shard for r in shard_by_bytes(df, F.col("b"), 9).collect()}
    total, before = sum((i * 37) % 101 for i in range(1000)), 0
    for i in range(1000):
        b = (i * 37) % 101
        assert got[i] == min(8, (2 * before + b) * 9 // (2 * total))
        before += b


def test_empty_zero_and_null_sizes(spark, empty):
    assert shard_documents(empty).count() == 0
    df = spark.createDataFrame([(1, None), (2, 0), (3, 0)], "id int, b long")
    assert {(r.shard, r.slot) for r in shard_by_bytes(df, F.col("b"), 4).collect()} == {(0, 0), (0, 1), (0, 2)}
