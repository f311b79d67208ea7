import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rarefold.llm.repeats import LongRepeats, _indexed, anchors, digest, repeated_starts

from .conftest import prose


def naive(texts, length):
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, p):
    rows = df.select("doc_id", "text").collect()
    want = sorted(repr((r.doc_id, *w)) for r, w in zip(rows, naive([r.text for r in rows], p.length)))
    assert want == sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in digest(df, p).collect())


def test_index_against_counting():
    rng, p = random.Random(6), LongRepeats(length=8, seed=4)
    for _ in range(60):
        segs = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(1, 12))]
        often = Counter(s[i : i + 8] for s in segs for i in range(len(s) - 7))
        for s, flags in zip(segs, repeated_starts(segs, p)):
            assert flags.tolist() == [often[s[i : i + 8]] > 1 for i in range(len(s) - 7)]


def test_anchors_cover_every_start_and_agree():
    rng, p = random.Random(6), LongRepeats(length=40, seed=16, block=64)
    shared = bytes(rng.randrange(256) for _ in range(70))
    one, two = b"x" * 100 + shared + b"q" * 9, bytes(rng.randrange(256) for _ in range(33)) + shared
    seen = []
    for d in (one, two):
        rows = list(anchors(d, p))
        assert [i for _, s, c, _, _ in rows for i in range(s, s + c)] == list(range(len(d) - 39))
        seen.append({(d[i : i + 40], h, s + lead - i) for h, s, c, lead, _ in rows for i in range(s, s + c) if d[i : i + 40] in shared})
    assert seen[0] == seen[1] and len(seen[0]) == 31
    assert not list(anchors(b"short", p))


def texts(rng):
    passage = prose(rng, 90)
    rows = []
    for i in range(160):  # a passage that many documents hold in different surroundings
        rows.append(f"{prose(rng, 3)} {passage[: rng.choice([300, 430, 600, 900])] if i % 2 else passage} {prose(rng, rng.randrange(0, 60))}")
    rows += [rows[0], rows[1], rows[2] + "é", "ab" * 900, "line of text\n" * 200, "é" * 250]
    return rows


def test_against_counting(spark, awkward):
    rng = random.Random(12)
    df = awkward.unionByName(spark.createDataFrame([(500 + i, t, "en", "s", 0, 0) for i, t in enumerate(texts(rng))], awkward.schema))
    check(df, LongRepeats())


def test_overfull_groups_are_split(spark, awkward):
    rng = random.Random(13)
    df = spark.createDataFrame([(500 + i, t, "en", "s", 0, 0) for i, t in enumerate(texts(rng))], awkward.schema)
    check(df, LongRepeats(group_bytes=2000, index_bytes=1000))


def test_empty(empty, spark):
    assert digest(empty).count() == 0
    check(spark.createDataFrame([(1, None, "", "", 0, 0), (2, "", "", "", 0, 0)], empty.schema), LongRepeats())


def test_kept_text(spark):
    long = "".join(f"w{i} " for i in range(200))
    docs = spark.createDataFrame([(1, f"head é {long} tail"), (2, f"other {long}end"), (3, "alone"), (4, None), (5, "é" * 250), (6, "x" + "é" * 249)], "doc_id long, text string")
    rows = {r.doc_id: r for r in digest(docs).collect()}
    assert rows[3].kept_text == "alone" and rows[4].kept_text == "" and rows[3].n_removed == 0
    assert "w100" not in rows[1].kept_text + rows[2].kept_text and rows[1].kept_text.startswith("head é")
    for r in rows.values():
        if r.n_removed == 0 or "\ufffd" not in r.kept_text:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_members_of_a_group_are_made_to_meet(spark):
    """Grouping is a need that adaptive execution keeps; a repartition before mapInArrow goes after a join on the same key."""
    core = "q" + "xyz" * 150
    rows = spark.range(0, 40, 1, 8).select(
        F.expr("cast(cast(id % 20 as string) as binary)").alias("grp"), F.expr("cast(cast(id as string) as binary)").alias("class"), F.lit(0).cast("long").alias("off"), F.lit(1).cast("long").alias("n"),
        F.lit(0).cast("long").alias("lead"), F.expr("cast(concat(char(97 + id % 26), id % 20, repeat(char(65 + id % 20), 5), '" + core + "') as binary)").alias("seg"),
    )
    members = rows.withColumn("home", F.col("class")).withColumn("starts", F.length("seg").cast("long") - 399)
    out = _indexed(members.join(members.groupBy("grp").count(), "grp"), LongRepeats())
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert out.select("class").distinct().count() == 40
