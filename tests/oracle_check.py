"""Local stand-in for the driver's correctness gate: run each catalogue
query on Spark and its oracle SQL on DuckDB, compare rows and values."""
from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, "/root/repo")
import __spark_entry__ as E  # noqa: E402
from tideline.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "int": "INTEGER", "float": "FLOAT",
                 "timestamp": "TIMESTAMP WITH TIME ZONE"}


def schema_diff(sdf, rel):
    s = {n: SPARK_TO_DUCK.get(t, t) for n, t in sdf.dtypes}
    d = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    return {k: (s.get(k), d.get(k)) for k in set(s) | set(d) if s.get(k) != d.get(k)}


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main(names=None, sf="/root/testdata/sf0.01"):
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sq = E.queries(), E.oracle_sql()
    ok = True
    for name in names or qs:
        t0 = time.time()
        sq_df = qs[name](spark, sf)
        sdf = sq_df.toPandas()
        t1 = time.time()
        if name not in sq:
            print(f"{name:32s} spark_rows={len(sdf)} (no oracle) {t1 - t0:.1f}s")
            continue
        rel = con.sql(sq[name])
        sch = schema_diff(sq_df, rel)
        ddf = rel.df()
        t2 = time.time()
        sc, sr = rows(sdf)
        dc, dr = rows(ddf)
        good = sc == dc and len(sr) == len(dr) and sr == dr and not sch
        ok &= good
        msg = "OK " if good else "BAD"
        print(f"{msg} {name:32s} rows spark={len(sr)} duck={len(dr)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s")
        if not good:
            if sch:
                print("   types", sch)
            if sc != dc:
                print("   cols", sc, dc)
            else:
                diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
                for a, b in diff:
                    print("   spark", a)
                    print("   duck ", b)
    return ok


if __name__ == "__main__":
    sys.exit(0 if main(sys.argv[1:] or None) else 1)
