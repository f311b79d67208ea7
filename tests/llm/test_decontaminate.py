import random
import re

import numpy as np
from pyspark.sql import functions as F

from rarefold.llm import decontaminate as D

from .conftest import prose


def slow_align(a, b, p):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (p.match if a[i - 1] == b[j - 1] else p.mismatch), h[i - 1][j] + p.gap, h[i][j - 1] + p.gap)
    return max(map(max, h))


def test_alignment_against_the_plain_table():
    rng, p = random.Random(1), D.Decontamination()
    for _ in range(300):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 30))])
        score, i, j = D.align(a, b, p)
        assert score == slow_align(a.tolist(), b.tolist(), p)
        assert score == D.align(a[:i], b[:j], p)[0]


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < rate / 3 else [prose(rng, 1)] if r < 2 * rate / 3 else [w, prose(rng, 1)] if r < rate else [w]
    return out


def test_planted_copies(spark, awkward, empty):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(14, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "lone"), (33, "two words"), (4, "item under a used id " + prose(rng, 20)), (35, "!!!")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows, want = [], set()
    for i in range(300):
        words = prose(rng, rng.randrange(5, 300)).split()
        if i % 3 == 0:
            item = items[rng.randrange(30)] if i % 2 else items[0]  # one item in many documents
            copy = edited(rng, item[1].split(), [0, 0.1, 0.2][i % 9 // 3])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in copy]
            want.add((1000 + i, item[0]))
        rows.append((1000 + i, ", ".join(words), "en", "s", 0, 0))
    rows += [rows[0]]
    df = awkward.unionByName(spark.createDataFrame(rows, awkward.schema))
    got = D.contaminated_documents(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.similarity == 1:
            lower = lambda t: re.findall(r"\w+", t.lower())
            assert lower(text[r.doc_id][r.start : r.end]) == lower(dict(items)[r.item_id])
    left = D.decontaminate(df, bench)
    gone = {d for d, _ in want}
    assert left.columns == df.columns and left.count() == df.where(~F.coalesce(F.col("doc_id").isin(list(gone)), F.lit(False))).count()
    assert D.contaminated_documents(empty, bench).count() == 0 and D.contaminated_documents(df, bench.limit(0)).count() == 0
    assert D.decontaminate(empty, bench).count() == 0


def test_short_items(spark, awkward):
    bench = spark.createDataFrame([(1, "lone"), (2, "Two words"), (3, "a b c d")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so Lone here", "", "", 0, 0), (2, "the two. Words", "", "", 0, 0), (3, "two lonely words", "", "", 0, 0), (4, "x a b q c d", "", "", 0, 0)], awkward.schema)
    got = {(r.doc_id, r.item_id) for r in D.contaminated_documents(df, bench).collect()}
    assert {(1, 1), (2, 2)} <= got and not any(d == 3 and i == 1 for d, i in got)


def test_edited_copies_beside_a_verbatim_one(spark, awkward):
    rng, p = random.Random(6), D.Decontamination()
    items = [(i, prose(rng, 16)) for i in range(12)]
    rows, want = [], set()
    for i, text in items:
        for k in range(16):
            words = [prose(rng, 1) if rng.random() < (0, 0.1, 0.2, 0.3)[k % 4] and k else w for w in text.split()]
            rows.append((100 * i + k, " ".join([prose(rng, 30), *words, prose(rng, 30)]), "", "", 0, 0))
            seeded = {tuple(text.split()[j : j + 3]) for j in range(14)} & {tuple(words[j : j + 3]) for j in range(14)}
            if seeded and D.align(D._hashes(text.split()), D._hashes(rows[-1][1].split()), p)[0] >= 16:
                want.add((100 * i + k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated_documents(spark.createDataFrame(rows, awkward.schema), bench).collect()}
    assert len(want) > 120 and got == want
