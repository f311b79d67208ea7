import random
import re
from collections import Counter

import pytest

from rarefold.llm import collocations as c


def plain(rows, p):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= p.least}
    out = {}
    for k, a in cand.items():
        lang, w = k[0], k[1:]
        if any(x[0] == lang and len(x) > len(k) and 100 * b >= p.subsumed * a and any(x[i : i + len(w)] == w for i in range(1, len(x) - len(w) + 1)) for x, b in cand.items()):
            continue
        cuts = []
        for i in range(1, len(w)):
            l, r = f[(lang, *w[:i])], f[(lang, *w[i:])]  # noqa: E741
            cuts.append((2_000_000 * a // (l + r), i, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, own in out.items() for i, x in enumerate(sorted(own)[: p.top], 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)] + ["É", "ß-x", "İ", "a\x1cb", "a b"]
    phrases = ["New York", "new york city", "as soon as possible", "Über alles", "as soon\x0bas", "in in in in in"]
    text = lambda: " ".join(rng.choice(words if rng.random() < 0.6 else phrases) + rng.choice(["", "", "", ".", ",\t", "!\n", "; "]) for _ in range(rng.randrange(0, 60)))
    out = [(rng.choice(["en", "de", None, ""]), text()) for _ in range(150)]
    return out + [("en", None), (None, ""), ("en", " .\t. "), ("fr", "only here"), *[out[0]] * 30, ("de", " ".join(rng.choice(words) for _ in range(30_000)))]


@pytest.mark.parametrize("held", [400_000, 50])
def test_against_plain_python(spark, rows, held, monkeypatch):
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, rank string").repartition(5)
    for p in (c.Collocations(least=8, top=40), c.Collocations(least=30)):
        monkeypatch.setattr(c, "HELD", held)
        monkeypatch.setattr(c, "HELD_PHRASES", held)
        got = c.collocations(docs, p)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(rows, p)


def test_nothing_frequent(awkward, empty):
    assert c.collocations(empty).count() == 0
    assert c.collocations(awkward, c.Collocations(least=10**6)).count() == 0


def test_large_products(spark):
    p = c.Collocations()
    stripes = spark.createDataFrame([("en", 0, ["x"], [6 * 10**17])] * 4, c.STRIPE)
    assert c.merge_words(stripes, p.least).first().n == [24 * 10**17]
    assert spark.sql("select (cast(4000000000000000000L as decimal(20,0)) * 2000000BD) div (cast(4000000000000000000L as decimal(20,0)) + cast(4000000000000000001L as decimal(20,0)))").first()[0] == 999999
