"""Side-by-side check of registered queries against DuckDB.

``python -m tests.oracle [prefix ...]`` runs the queries whose names start with one of
the prefixes at ``$SF_DIR`` (default sf0.01) and prints every difference.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v: object) -> object:
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}"
    if isinstance(v, int):
        return f"{v:d}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"rows-only n={len(got)} {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    stat = f"n={len(a)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if a == b:
        return bool(a), stat + ("" if a else " EMPTY: nothing was compared")
    sa, sb = set(a), set(b)
    return False, (
        f"{stat} want n={len(b)} cols={sorted(df.columns)}\n   only spark: {sorted(sa - sb)[:3]}\n"
        f"   only duck: {sorted(sb - sa)[:3]}"
    )


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from fleetsift.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        try:
            ok, why = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, why = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, why, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
