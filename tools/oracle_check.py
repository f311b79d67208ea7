"""Run registered queries on Spark and their SQL on DuckDB; compare like the driver.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from rarefold.plans.catalog import load_all  # noqa: E402
from rarefold.session import get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    try:
        import pandas as pd

        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for r in pdf[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in r))
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark("local[8]", shuffle_partitions=8, driver_memory="16g")
    queries, oracles = load_all()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name in names or list(queries):
        t0 = time.time()
        try:
            sdf = queries[name](spark, sf)
            pdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"ROWS {name}: {len(pdf)} rows ({ts:.1f}s) cols={list(pdf.columns)}")
            continue
        try:
            odf = con.execute(oracles[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        c1, r1 = rows_of(pdf)
        c2, r2 = rows_of(odf)
        if c1 != c2:
            print(f"FAIL {name}: columns {c1} vs {c2}")
            bad += 1
        elif len(r1) != len(r2):
            print(f"FAIL {name}: rows {len(r1)} vs {len(r2)}")
            bad += 1
        elif r1 != r2:
            diff = [(a, b) for a, b in zip(r1, r2) if a != b][:3]
            print(f"FAIL {name}: values differ, e.g. {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(r1)} rows ({ts:.1f}s)")
            ok += 1
    print(f"ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
