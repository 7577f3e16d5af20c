"""Run registered queries beside their SQL and compare values: ``python -m workload.check [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from workload.oracle import ORACLE
from workload.queries import QUERIES
from workload.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows: list[dict]) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(r)) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    spent = time.time() - start
    if name not in ORACLE:
        return f"rows {len(got)} (no SQL) {spent:.1f}s"
    start = time.time()
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    timing = f"{spent:.1f}s / {time.time() - start:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)} {timing}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return f"ok {len(a)} rows {timing}"
    left, right = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"DIFF spark {len(a)} sql {len(b)} {timing} {sorted(df.columns)}\n   spark {left[:4]}\n   sql   {right[:4]}"


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        sf_dir = f"/root/testdata/{args.pop(0)}"
    names = [n for n in QUERIES if not args or any(n == a or n.startswith(a + "_") or (len(a) == 1 and n.startswith(a)) for a in args)]
    spark = local_session(cpus=8, shuffle_partitions=8)
    con = connect(sf_dir)
    for name in names:
        try:
            print(f"{name:28s} {compare(spark, con, name, sf_dir)}", flush=True)
        except Exception as problem:
            print(f"{name:28s} ERROR {type(problem).__name__}: {str(problem)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
