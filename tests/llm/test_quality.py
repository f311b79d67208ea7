import random
import re
from collections import Counter

from rarefold.llm import quality as Q

from .conftest import prose


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    hit = {k for i, g in enumerate(grams) if often[g] > 1 for k in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_against_plain_python(spark, awkward, empty):
    rng = random.Random(2)
    p = prose(rng, 40)
    extra = spark.createDataFrame([(900, f"{p}\n{p}#|<\n\n{p[:100]}", "en", "s", 0, 0), (901, "x " * 9, "en", "s", 0, 0), (902, "\x0b\x0cé à b\r\n \n", None, None, 0, 0)], awkward.schema)
    df = awkward.unionByName(extra)
    got = sorted(repr((r.text, *(r[c] for c in Q.STATS))) for r in Q.with_statistics(df).collect())
    assert got == sorted(repr((r.text, *naive(r.text))) for r in df.collect())
    assert Q.with_statistics(empty).count() == 0


def test_verdict(spark, awkward, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(30, 300)), "en", f"s{i % 2}", 0, 0) for i in range(600)]
    odd = [(1000 + i, " ".join("#|%" if k % 2 else "a" for k in range(60 + i)) , "en", "s0", 0, 0) for i in range(20)]
    df = spark.createDataFrame(rows + odd, awkward.schema)
    out = {r.doc_id: r for r in Q.judge(df).collect()}
    assert len(out) == 620 and not any(out[1000 + i].kept for i in range(20))
    assert sum(out[i].kept for i in range(600)) >= 597
    few = Q.judge(awkward).collect()
    assert len(few) == awkward.count() and all(not (r.base_failed and r.kept) for r in few)
    assert Q.judge(empty).count() == 0
