import random
import re

from rarefold.llm.graph import components
from rarefold.llm.minhash import near_duplicates, shingles, signature, NearDuplicates

from .conftest import prose


def naive_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def naive_components(texts):
    sets = [naive_set(t) for t in texts]
    comp = list(range(len(texts)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                comp[top(i)] = top(j)
    return sets, [top(i) for i in range(len(texts))]


def check(df):
    rows = df.select("doc_id", "text").collect()
    sets, comp = naive_components([r.text for r in rows])
    least = {}
    for r, c in zip(rows, comp):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(repr((r.doc_id, len(s), least.get(c), r.doc_id == least.get(c))) for r, s, c in zip(rows, sets, comp))
    assert want == sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in near_duplicates(df).collect())


def test_against_all_pairs(spark, awkward):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = prose(rng, rng.randrange(8, 260)).split()
        for k in range(rng.randrange(1, 9)):
            rows.append((1000 + 50 * g + k, " ".join(words).upper() if k == 3 else " ".join(words), "en", "s", 0, 0))
            for _ in range(max(1, len(words) // 150)):  # drifts, so that chains link ends that are not similar
                words[rng.randrange(len(words))] = prose(rng, 1)
    check(awkward.unionByName(spark.createDataFrame(rows, awkward.schema)))


def test_passage_shared_by_many(spark, awkward):
    rng = random.Random(9)
    shared = prose(rng, 60)
    rows = [(2000 + i, shared + " " + prose(rng, 4 + i % 40), "en", "s", 0, 0) for i in range(90)]
    check(spark.createDataFrame(rows, awkward.schema))


def test_empty(spark, empty):
    assert near_duplicates(empty).count() == 0
    check(spark.createDataFrame([(1, None, "", "", 0, 0), (2, " ", "", "", 0, 0)], empty.schema))


def test_signature_estimates_similarity():
    rng, p = random.Random(3), NearDuplicates()
    words = prose(rng, 400).split()
    other = words[:60] + prose(rng, 20).split() + words[80:]
    a, b = shingles(" ".join(words)), shingles(" ".join(other))
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((signature(a, p) == signature(b, p)).mean() - true) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300), (7, 100)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 100, 150, 200], 0), **dict.fromkeys([500, *range(600, 650)], 500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
