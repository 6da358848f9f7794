"""Run registered queries in Spark and their SQL in DuckDB, and compare.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def normalize(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(_key(r[i]) for i in order) for r in rows))


def differences(spark, con, sf: str, fn, sql: str) -> str | None:
    """None if both agree, else a short account of what differs."""
    df = fn(spark, sf)
    mine = normalize(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = normalize(names, cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return (f"rows {len(mine[1])} / {len(theirs[1])}; only in Spark "
                f"{len(a - b)} {sorted(a - b)[:2]}; only in SQL {len(b - a)} "
                f"{sorted(b - a)[:2]}")
    return None if mine[1] else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session
    args = sys.argv[1:]
    sf = args.pop(0) if args else "/root/testdata/sf0.001"
    spark, con = make_session(), connect(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            verdict = differences(spark, con, sf, fn, sqls[name])
        except Exception as error:  # keep going, report at the end
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None
        print(f"{name:24s} {time.time() - start:6.1f}s "
              f"{'ok' if verdict is None else verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
