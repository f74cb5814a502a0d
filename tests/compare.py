"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_cell(x) for x in v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v))
    return (type(v).__name__, v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return True, f"{took:6.2f}s rows={len(got)} (no SQL)"
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3]
        missing = [x for x in b if x not in set(a)][:3]
        return False, f"{took:6.2f}s rows {len(a)} vs {len(b)}\n   spark: {extra}\n   sql:   {missing}"
    return True, f"{took:6.2f}s rows={len(a)}" + ("  EMPTY" if not a else "")


def main() -> int:
    import __spark_entry__ as entry

    from playtrace.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("compare")
    con = connection(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} match; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
