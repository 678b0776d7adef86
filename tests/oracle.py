"""Run registered queries next to their SQL and compare the values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows, width):
    found = [set() for _ in range(width)]
    for row in rows:
        for i, v in enumerate(row):
            if v is not None:
                found[i].add(type(v).__name__)
    return found


def compare(spark, con, sf_dir, build, sql):
    """None if equal, else a short text about the first difference."""
    df = build(spark, sf_dir)
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = canonical([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only ours {list(set(got) - set(want))[:3]}, only SQL {list(set(want) - set(got))[:3]}"
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b]
        return f"values differ in {len(pairs)}: {pairs[0]}"
    a, b = kinds(got, len(got_columns)), kinds(want, len(got_columns))
    for name, x, y in zip(got_columns, a, b):
        if x and y and x != y:
            return f"type of {name}: {x} != {y}"
    return None


def main(argv):
    from cueweave.plans import ORACLES, QUERIES
    from cueweave.session import build_session

    sf_dir = argv[0]
    names = argv[1:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in ORACLES:
                note = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                note = None
                rows = QUERIES[name](spark, sf_dir).collect()
                print(f"   {name}: {len(rows)} rows, no SQL; first {str(rows[:1])[:200]}")
        except Exception as error:  # noqa: BLE001 - report and go on
            note = f"{type(error).__name__}: {str(error)[:700]}"
        bad += note is not None
        print(f"{'FAIL' if note else 'ok  '} {name} {time.time() - began:.2f}s {note or ''}"[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main(sys.argv[1:])
