"""Run registered queries beside their SQL and compare rows. Usage: python tests/oracle.py [sf_dir] [name part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return "null" if v is None else str(v)


def canonical(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, entry) -> tuple[bool, str]:
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if entry.sql is None:
        return len(mine) > 0, f"rows {len(mine)} {took:.1f}s (no SQL)"
    cur = con.execute(entry.sql)
    cols = [c[0] for c in cur.description]
    theirs = canonical(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return False, f"rows {len(mine)}/{len(theirs)} cols {sorted(cols)}\n   spark only {sorted(a - b)[:3]}\n   sql only   {sorted(b - a)[:3]}"
    return True, f"rows {len(mine)} {took:.1f}s"


def main() -> int:
    from hearthline.queries import load_registry
    from hearthline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                 "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, entry in load_registry().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, entry)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
