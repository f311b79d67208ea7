import math
import random
import re
from collections import Counter

import pytest

from rarefold.llm.lmscore import CrossEntropy, cross_entropy_difference


def naive(rows, target, p):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    chosen = [words(t) for i, t in rows if i is not None and i in target]
    count = Counter(w for ws in chosen for w in ws)
    vocab = sorted((w for w in count if count[w] >= p.min_count), key=lambda w: (-count[w], w))[: p.vocabulary]
    keep, size = set(vocab), len(vocab) + 2
    ids = lambda ws: ["<s>", *(w if w in keep else "<unk>" for w in ws)]
    models = []
    for docs in (chosen, [words(t) for _, t in rows]):
        one, two, ctx = Counter(), Counter(), Counter()
        for ws in map(ids, docs):
            one.update(ws[1:])
            two.update(zip(ws, ws[1:]))
            ctx.update(ws[:-1])
        models.append((one, two, ctx, sum(one.values())))
    out = []
    for i, t in rows:
        ws, losses = ids(words(t)), []
        for one, two, ctx, n in models:
            loss = 0.0
            for v, w in zip(ws, ws[1:]):
                single = (one[w] + 1) / (n + size)
                loss -= math.log(p.weight * two[v, w] / ctx[v] + (1 - p.weight) * single if ctx[v] else single)
            losses.append(loss / (len(ws) - 1) if len(ws) > 1 else None)
        out.append((i, len(ws) - 1, *losses))
    return out


def check(df, target, p):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    ids = df.sparkSession.createDataFrame([(t,) for t in target], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in cross_entropy_difference(df, ids, p).collect()), key=key)
    want = sorted(naive(rows, set(target) - {None}, p), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2]
        if w[2] is None:
            assert g[2:] == (None, None, None)
        else:
            assert g[2:] == pytest.approx((w[2], w[3], w[2] - w[3]), abs=1e-6)


def test_against_plain_counts(awkward):
    check(awkward, [*range(0, 40, 3), None, 999, 3], CrossEntropy())
    check(awkward, range(30), CrossEntropy(vocabulary=50, parts=4, batch=3, flush=500, group=100))


def test_no_target_and_empty(awkward, empty):
    check(awkward, [], CrossEntropy())
    assert cross_entropy_difference(empty, empty.select("doc_id")).count() == 0


def test_separates_styles(spark, awkward):
    rng = random.Random(1)
    a = [(i, " ".join(rng.choice(["red", "green", "blue"]) + " " + rng.choice(["cat", "dog"]) for _ in range(40))) for i in range(100)]
    b = [(100 + i, " ".join(rng.choice(["cat", "dog"]) + " " + rng.choice(["red", "odd", "blue"]) + " zap" for _ in range(30))) for i in range(100)]
    df = spark.createDataFrame(a + b, "doc_id long, text string")
    score = {r.doc_id: r.score for r in cross_entropy_difference(df, df.where("doc_id < 20").select("doc_id")).collect()}
    assert max(score[i] for i in range(20, 100)) < min(score[i] for i in range(100, 200))
