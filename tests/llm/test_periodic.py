import hashlib
import random
import re
import time

from rarefold.llm.periodic import collapse, digest, find_runs, periodic_runs, with_tail


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            k = i
            while k < n and w[k] == w[k - q]:
                k += 1
            if k - i + q >= max(6, 4 * q):
                out.setdefault((i - q, k - i + q), q)
            i = k + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_against_all_lags():
    rng = random.Random(3)
    for round_ in range(3000):
        letters = "ab" if round_ % 3 else "abcde"
        parts = []
        while sum(map(len, parts)) < rng.choice([5, 20, 60, 200, 500]):
            block = [rng.choice(letters) for _ in range(rng.randrange(1, rng.choice([3, 8, 40])))]
            parts.append(block * rng.choice([1, 1, 2, 3, 4, 5, 9]))
        w = [x for part in parts for x in part] * rng.choice([1, 1, 1, 4, 5])
        assert find_runs(w) == plain_runs(w), w
    for w in (list(fibonacci(34)) * 5, list(fibonacci(89)) * 4, list("aaaaaaab" * 40), (["a"] * 100 + ["b"]) * 9, (list("ab" * 30) + ["c"]) * 6 + list("ab" * 50), ["a"] * 5, ["a"] * 6, list("abababab"), list("abababa")):
        assert find_runs(w) == plain_runs(w), w


def test_steps_stay_near_linear():
    for w in (["a"] * 200_000, (["a"] * 1000 + ["b"]) * 200, (["a"] * 999 + ["b"]) * 100 + (["a"] * 1001 + ["c"]) * 100, [str(i % 50_000) for i in range(200_000)]):
        t = time.time()
        find_runs(w)
        assert time.time() - t < 20


def want(r):
    w = with_tail(re.findall("[^\x20\x09-\x0d]+", r.text or ""), r.doc_id)
    runs = plain_runs(w)
    top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))
    assert kept == " ".join(collapse(w, runs))
    return (r.doc_id, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_documents_against_plain_python(spark, awkward, empty):
    short = awkward.where("text is null or length(text) < 100000")
    more = spark.createDataFrame([(1000 + i, f"x{i} " + "spam eggs " * i) for i in range(60)], "doc_id long, text string")
    docs = short.select("doc_id", "text").unionByName(more)
    got = digest(periodic_runs(docs, tails=True))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(want(r)) for r in docs.collect())
    assert got.where("n_runs > 0").count() > 40
    assert digest(periodic_runs(empty)).count() == 0
    assert periodic_runs(awkward).where("length(collapsed) > 100000").count() == 1  # the long text, whole


def test_tail():
    w = [str(i) for i in range(100)]
    import zlib

    for d in range(300):
        h = zlib.crc32(str(d).encode())
        if h % 10:
            assert with_tail(w, d) == w
        else:
            a, g = h // 10 % 100, h // 10
            p = 1 + (100 - a) // (3 + g % 8)
            assert with_tail(w, d) == [w[i] if i < a else w[a + (i - a) % p] for i in range(100)]
