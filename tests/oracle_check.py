"""Run registered queries against their SQL. ``python tests/oracle_check.py [sf] [name ...]``"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, con, name, sf_dir):
    """Empty when rows, columns and values agree in any order."""
    df = queries()[name](spark, sf_dir)
    got_columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*got_columns).collect()), key=repr)
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    rows = cur.fetchall()
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(r[i] for i in order) for r in rows), key=repr)
    if got_columns != sorted(columns):
        return f"columns {got_columns} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            return f"{g} != {w}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from logweave.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            why = differences(spark, con, name, sf_dir) if name in oracle_sql() else f"rows only: {queries()[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(why) and not why.startswith("rows only")
        print(f"{name:28s} {time.time() - t:6.1f}s {why or 'ok'}", flush=True)
    print("failed", failed)
    sys.exit(bool(failed))
