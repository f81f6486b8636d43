"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [dir] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return "null" if v is None else str(v)


def kind(type_name: str) -> str:
    t = type_name.lower()
    return {"long": "bigint", "integer": "integer", "int": "integer", "string": "varchar"}.get(t, t)


def compare(spark, con, fn, query: str, sf: str) -> tuple[str, int]:
    """'' when equal, else what differs; and the number of rows."""
    got = fn(spark, sf)
    rel = con.sql(query)
    names = sorted(got.columns)
    if names != sorted(rel.columns):
        return f"columns {names} / {sorted(rel.columns)}", 0
    types = {f.name: kind(f.dataType.typeName()) for f in got.schema}
    other = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    diff = {n: (types[n], other[n]) for n in names if types[n] != other[n] and "array" not in types[n]}
    order = [rel.columns.index(n) for n in names]
    left = sorted(tuple(cell(r[n]) for n in names) for r in got.collect())
    right = sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())
    if left != right:
        extra = [x for x in left if x not in set(right)][:2]
        missing = [x for x in right if x not in set(left)][:2]
        return f"rows {len(left)} / {len(right)}; only here {extra}; only there {missing}"[:700], len(left)
    return (f"types {diff}" if diff else ""), len(left)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from sievelab.session import get_spark

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_spark(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in argv[1:] or queries:
        start = time.time()
        try:
            if key in oracles:
                problem, n = compare(spark, con, queries[key], oracles[key], sf)
            else:
                n = len(queries[key](spark, sf).collect())
                problem = "" if n else "no rows"
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", 0
        bad += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {'V' if key in oracles else 'R'} {key:28s} rows={n:7d} {time.time() - start:6.1f}s {problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
