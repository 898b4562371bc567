"""Run queries against their oracle: python -m checks.compare [folder] [name part ...]."""

from __future__ import annotations

import math
import sys
import threading
import time
import traceback

import duckdb

from checks import registry
from checks import load_all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    return str(v)


def differences(spark, con, name: str, folder: str) -> tuple[int, list[str]]:
    start = time.time()
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    print(f"{time.time() - start:6.1f}s", end=" ", flush=True)
    if name not in registry.ORACLES:
        return len(ours), []
    timer = threading.Timer(45, con.interrupt)
    timer.start()
    try:
        cur = con.execute(registry.ORACLES[name])
    finally:
        timer.cancel()
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return len(ours), [f"columns {columns} / {sorted(names)}"]
    at = [names.index(c) for c in columns]
    types = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    theirs = sorted(tuple(_text(r[i]) for i in at) for r in rows)
    notes = []
    pairs = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    for field, kind in df.dtypes:
        if pairs.get(kind, kind) != types[field]:
            notes.append(f"type {field}: {kind} / {types[field]}")
    if ours == theirs:
        return len(ours), ["(types) " + "; ".join(notes)] if notes else []
    a, b = set(ours), set(theirs)
    return len(ours), [f"rows {len(ours)} / {len(theirs)}; {columns}"] + [f"  ours   {x}"[:300] for x in sorted(a - b)[:3]] + [
        f"  oracle {x}"[:300] for x in sorted(b - a)[:3]
    ]


def main() -> None:
    from pagewarden.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    load_all()
    spark = local_session("8")
    con = connect(folder)
    bad = 0
    for name in registry.QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            n, diff = differences(spark, con, name, folder)
        except Exception as error:  # report and go on
            n, diff = -1, ["".join(traceback.format_exception_only(error))[:600]]
        real = [d for d in diff if not d.startswith("(types)")]
        bad += bool(real)
        mark = "BAD " if real else ("ok  " if name in registry.ORACLES else "rows")
        print(f"{mark} {name} {n} rows {time.time() - start:.1f}s", flush=True)
        for d in diff:
            print("     ", d, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
