"""Run registered queries and their SQL side by side."""
from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_plain(r[i]) for i in order) for r in rows])


def types_of(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def check(spark, con, build, sql, sf_dir):
    """Returns (ok, message, rows)."""
    df = build(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, "rows only", len(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        a, b = set(got), set(want)
        return False, f"{len(got)} vs {len(want)} rows; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"[:900], len(got)
    return True, "equal", len(got)


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from loamgrid.session import build_session
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="10g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con, oracle, bad = connect(sf_dir), e.oracle_sql(), 0
    for name, build in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, message, n = check(spark, con, build, oracle.get(name), sf_dir)
        except Exception as problem:
            ok, message, n = False, f"{type(problem).__name__}: {str(problem)[:700]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} rows={n} {time.time() - start:.2f}s {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
