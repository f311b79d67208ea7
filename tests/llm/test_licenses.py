import random
import re

import pytest

from rarefold.llm.licenses import NOTICES, PHRASES, common_words, run_hashes, scan_licenses, words_of


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    at, labels, more = [], set(), set()
    for t in PHRASES:
        own = t.text.split()
        for i in range(len(w) - len(own) + 1):
            if w[i : i + len(own)] == own:
                at.append(i)
                labels.add(t.label)
    for t in NOTICES:
        if t.share >= 1:
            own = words_of(t.text)
            if any(w[i : i + len(own)] == own for i in range(len(w) - len(own) + 1)):
                more.add(t.label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), labels | more


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        rng.choice([lambda: w.insert(i, "xyz"), lambda: w.pop(i), lambda: w.__setitem__(i, "xyz")])()
    return " ".join(w)


@pytest.fixture(scope="module")
def docs(spark, awkward):
    rng = random.Random(8)
    filler = "the of licensed software permission is granted mit license apache general public the above notice".split()
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(100 + i, prose(rng.randrange(0, 120))) for i in range(80)]
    rows += [(200, "MIT License mit  license, MIT-LICENSE mit licenses"), (201, "General Public\nGeneral Public License"), (202, "Licensed under CC BY-NC 4.0."), (203, "mit"), (204, "é mit license é " * 500)]
    for i, t in enumerate(NOTICES):
        rows.append((300 + i, f"{prose(20)} qq {t.text} qq {prose(20)}"))
        if t.share < 1:
            rows += [(400 + i, f"some words {edited(rng, t.text, 2)} and others"), (500 + i, " ".join(t.text.split()[: len(t.text.split()) // 4]))]
    rows += [rows[-1]] * 40
    return awkward.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).cache()


def test_against_plain_python(docs, empty):
    got = scan_licenses(docs)
    rows = sorted(tuple(r)[:6] for r in got.collect() if r.doc_id is not None)
    want = sorted((r.doc_id, *plain(r.text)[:5]) for r in docs.collect() if r.doc_id is not None)
    assert list(map(repr, rows)) == list(map(repr, want))
    texts = {r.doc_id: r.text for r in docs.where("doc_id >= 100").collect()}
    for r in got.where("doc_id >= 100").collect():
        labels = set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(labels)) and plain(texts[r.doc_id])[5] <= labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
        if 300 <= r.doc_id < 500:
            assert NOTICES[r.doc_id % 100].label in labels, (r, texts[r.doc_id])
        if 300 <= r.doc_id < 400:
            assert r.score == 1
        if r.doc_id >= 500 or r.doc_id < 200:  # a quarter of a notice, or its words shuffled, is none
            assert labels == plain(texts[r.doc_id])[5], r
    assert got.where("doc_id is null").count() == 1 and got.count() == docs.count()
    assert scan_licenses(empty).count() == 0


def test_hashes():
    texts = ["Ab cd ab CD", "", "ab cd", "é-ab cd", "cd"]
    counts, text, place, h = run_hashes([t.encode() for t in texts], 2)
    assert counts.tolist() == [4, 0, 2, 3, 1]
    assert list(zip(text.tolist(), place.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (2, 0), (3, 0), (3, 1)]
    assert h[0] == h[2] == h[3] == h[5] and len(set(h.tolist())) == 3


def test_common_words():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert common_words(a, b) == best[-1][-1]
