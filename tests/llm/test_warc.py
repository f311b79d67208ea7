import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rarefold.llm import warc as W

SCHEMA = "record_id string, warc_type string, profile string, target_uri string, warc_date timestamp, http_status int, headers map<string,string>, payload string, url string, at int"
T0 = datetime(2024, 5, 1)


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://user@WWW.Example.org:80/a/b/?utm_source=x&b=2&a=1#top", "example.org/a/b?a=1&b=2"),
        ("https://m.example.org", "example.org"),
        ("https://example.org/?ref=x", "example.org"),
        ("//example.org/A?", "example.org/A"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(W.canonical_url(F.col("u")).alias("c")).first().c == want


def naive(rows):
    out = []
    full = [r for r in rows if r[1] == "response" and r[5] == 200 and r[7] is not None and r[3] and r[4]]
    for r in rows:
        if r[1] != "revisit" or r[2] not in W.NOT_MODIFIED:
            continue
        own = {k.lower(): v for k, v in (r[6] or {}).items()}
        was = [f for f in full if r[3] and r[4] and f[3] == r[3] and f[4] < r[4]]
        if not was:
            out.append((r[0], "missing", None, None, own))
            continue
        last = max(was, key=lambda f: (f[4], f[0]))
        old = {k.lower(): v for k, v in (last[6] or {}).items()}
        weak = lambda t: (t or "").removeprefix("W/")
        ok = weak(own["etag"]) == weak(old.get("etag")) if own.get("etag") else own["last-modified"] == old.get("last-modified") if own.get("last-modified") else None
        if ok is False:
            out.append((r[0], "mismatch", last[0], None, own))
        else:
            merged = {**old, **{k: v for k, v in own.items() if k not in W.KEPT_FIELDS}}
            out.append((r[0], "resolved" if ok else "unvalidated", last[0], last[7], merged))
    return sorted(map(repr, ((a, b, c, d, sorted(e.items())) for a, b, c, d, e in out)))


def log(n, seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = "hot.org/x" if rng.random() < hot else rng.choice([f"u{rng.randrange(12)}.org", None])
        when = None if rng.random() < 0.02 else T0 + timedelta(minutes=rng.randrange(n // 2))
        if rng.random() < 0.4:
            head = rng.choice([None, {"ETag": '"a"', "Content-Length": "9", "X": "1"}, {"etag": 'W/"b"', "Last-Modified": "d1"}, {"Last-Modified": "d2"}])
            rows.append((f"r{i}", "response", None, url, when, rng.choice([200, 200, 404]), head, rng.choice(["body", None, "", f"p{i}"]), "clash", i))
        else:
            head = rng.choice([None, {"ETag": '"a"', "x": "2", "Content-Length": "0"}, {"ETag": '"b"'}, {"last-modified": "d1", "Content-Type": "no"}, {"ETag": "", "Last-Modified": "d2"}])
            rows.append((f"v{i}", "revisit", rng.choice([*W.NOT_MODIFIED, "other"]), url, when, 304, head, None, "clash", i))
    return rows


@pytest.mark.parametrize("slice_rows", [50_000, 20])
def test_against_plain_search(spark, slice_rows):
    rows = log(700, 3, 0.35)
    rows.append(next(r for r in rows if r[1] == "revisit"))
    got = W.resolve_revisits(spark.createDataFrame(rows, SCHEMA), slice_rows).collect()
    text = [(r.record_id, r.status, r.response_id, r.payload, sorted((k.lower(), v) for k, v in r.headers.items())) for r in got]
    assert sorted(map(repr, text)) == naive(rows)


def test_empty(spark):
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
