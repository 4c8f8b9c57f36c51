"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

    python tests/oracle_check.py [sf dir] [name or prefix* ...]
"""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "n",
                  round(v, 4) if isinstance(v, float) else v) if v is not None else (True, "", 0) for v in row)


FAMILY = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(df, con, sql):
    """'' when equal, otherwise what differs. Floats must agree exactly."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    types = dict(df.dtypes)
    got = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    idx = [list(rel.columns).index(c) for c in cols]
    rtypes = [str(t) for t in rel.types]
    bad_types = [
        f"{c}: {types[c]} / {rtypes[i]}" for c, i in zip(cols, idx) if FAMILY.get(types[c], types[c]) != rtypes[i]
    ]
    want = [tuple(_plain(r[i]) for i in idx) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    note = f" types differ: {bad_types}" if bad_types else ""
    if bad:
        close = all(
            all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
                for a, b in zip(g, w)) for g, w in bad)
        return f"{'CLOSE' if close else 'DIFF'} {len(bad)}/{len(got)} {cols} {bad[0]}" + note
    return ("ok-but" + note) if note else ("" if got else "EMPTY")


def main(argv):
    import __spark_entry__ as entry
    from trustlake.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("oracle-check", master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                result = compare(df, con, oracles[name])
            else:
                result = f"rows-only n={len(df.collect())}"
        except Exception as exc:  # report and go on with the next query
            result = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        ok = result == "" or result.startswith("rows-only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
