"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, int):
        return float(x)
    return x


def canonical(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"{len(got)} rows, {t1 - t0:.1f}s spark, {t2 - t1:.1f}s sql"
    if sorted(df.columns) != sorted(names):
        return False, f"{note}; columns {sorted(df.columns)} and {sorted(names)}"
    a, b = canonical(df.columns, got), canonical(names, want)
    if a != b:
        return False, f"{note} vs {len(want)}; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
    return True, note


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    spark, con = make_session(), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            if name in oracles:
                ok, note = compare(spark, con, query, oracles[name], sf_dir)
            else:
                t0 = time.time()
                ok, note = True, f"{query(spark, sf_dir).count()} rows, {time.time() - t0:.1f}s, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note[:900], flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
