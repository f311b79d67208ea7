import math
import random

import numpy as np
import pytest

from rarefold.functions import quantile as Q


@pytest.mark.parametrize("small", [1_000_000, 40, 1])
def test_against_numpy_with_heavy_values(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "SMALL", small)
    monkeypatch.setattr(Q, "FINER", 8)
    rng = random.Random(3)
    cols = {
        "half": [7.0] * 600 + [rng.gauss(0, 5) for _ in range(600)],
        "spread": [rng.expovariate(1) for _ in range(1200)],
        "one": [2.5] * 1200,
        "ties": [float(rng.randrange(3)) for _ in range(1200)],
        "edges": [rng.choice([-math.inf, math.inf, 0.0, -0.0, 1e300, 5e-324]) for _ in range(1200)],
    }
    rows = list(zip(*cols.values(), strict=True))
    rng.shuffle(rows)
    rows = [tuple(None if i % 11 == 0 else math.nan if i % 13 == 0 else v for v in r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(6)
    clean = {c: sorted(r[j] for r in rows if r[j] is not None and not math.isnan(r[j])) for j, c in enumerate(cols)}
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = Q.exact_quantiles(df, list(cols), q, n_buckets=8)
        for c, v in clean.items():
            h = (len(v) - 1) * q
            lo, hi = v[math.floor(h)], v[math.ceil(h)]
            want = lo + (h - math.floor(h)) * (hi - lo)
            assert got[c] == want or math.isnan(got[c]) and math.isnan(want) or np.isclose(got[c], want, rtol=0, atol=0), (c, q, small)


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "a double")
    assert Q.exact_quantiles(df, ["a"]) == {"a": None} and Q.exact_quantiles(df.limit(0), ["a"]) == {"a": None}
