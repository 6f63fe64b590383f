"""Run queries beside their SQL in DuckDB and compare rows, columns and values."""

from __future__ import annotations

import math
import sys
import time
import traceback
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from workload.oracle import ORACLE
from workload.queries import QUERIES, TABLES


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, (datetime, date)):
        return str(value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_connection(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, con, name: str, sf: str) -> str:
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return f"rows only ({len(got)})"
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"VALUES {len(bad)} of {len(got)}: {bad[0]}" if bad else f"ok ({len(got)})"


if __name__ == "__main__":
    from terrace.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session("8")
    connection = oracle_connection(folder)
    for query in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            outcome = compare(session, connection, query, folder)
        except Exception as error:
            traceback.print_exc(limit=-3)
            outcome = f"ERROR {type(error).__name__}: {str(error)[:300]}"
        print(f"{query:26s} {time.time() - start:6.2f}s  {outcome[:400]}", flush=True)
