"""Run registered queries next to their oracle SQL and report differences.

    python tools/compare.py [--sf /root/testdata/sf0.01] [name prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks import ORACLES, QUERIES  # noqa: E402
from resight.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    out = {}
    for c in frame.columns:
        col = frame[c]
        if pd.api.types.is_float_dtype(col):
            col = col.astype(float)
        out[c] = col.map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else (
            repr(float(v)) if isinstance(v, float) else str(v)))
    return pd.DataFrame(out).sort_values(list(out)).reset_index(drop=True)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--full", action="store_true", help="exact names instead of prefixes")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    bad, con = 0, oracle(opts.sf)
    for name, fn in QUERIES.items():
        if opts.names and not any(name == n or (not opts.full and name.startswith(n)) for n in opts.names):
            continue
        began = time.time()
        try:
            got = fn(spark, opts.sf).toPandas()
            spent = time.time() - began
            if name not in ORACLES:
                print(f"rows {name}: {len(got)} rows, {spent:.1f}s", flush=True)
                continue
            began = time.time()
            want = con.execute(ORACLES[name]).df()
            took = time.time() - began
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
            continue
        if sorted(got.columns) != sorted(want.columns):
            bad += 1
            print(f"FAIL {name}: columns {sorted(got.columns)} != {sorted(want.columns)}")
            continue
        a, b = normal(got), normal(want)
        same = a.equals(b)
        note = "" if kinds(got) == kinds(want) else f" kinds {kinds(got)} {kinds(want)}"
        print(f"{'ok  ' if same else 'FAIL'} {name}: {len(a)}/{len(b)} rows, {spent:.1f}s / {took:.1f}s{note}", flush=True)
        if not same:
            bad += 1
            merged = a.merge(b, how="outer", indicator=True)
            print(merged[merged["_merge"] != "both"].head(8).to_string())
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
