"""Run queries beside their SQL in DuckDB and compare names, types, row counts and values."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DOUBLE[]": "array<double>", "INTEGER[]": "array<int>", "VARCHAR[]": "array<string>", "BIGINT[]": "array<bigint>", "BOOLEAN[]": "array<boolean>",
    "BOOLEAN[][]": "array<array<boolean>>", "DOUBLE[][]": "array<array<double>>",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None if equal, else what differs."""
    began = time.time()
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    types = dict(df.dtypes)
    rows = sorted(tuple(plain(v) for v in row) for row in (tuple(r) for r in df.select(*names).collect()))
    compare.spent = time.time() - began
    if sql is None:
        return None if rows else "no rows"
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    raw = cursor.fetchall()
    if sorted(found) != names:
        return f"columns {names} vs {sorted(found)}"
    for n in names:
        if DUCK_TYPES.get(kinds[n], kinds[n]) != types[n]:
            return f"type of {n}: {types[n]} vs {kinds[n]}"
    at = [found.index(n) for n in names]
    want = sorted(tuple(plain(row[i]) for i in at) for row in raw)
    if len(rows) != len(want):
        return f"rows {len(rows)} vs {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ ({names}), first {bad[0]}"
    return None if rows else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tripmill.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    conf = dict(pair.split("=", 1) for pair in os.environ.get("COMPARE_CONF", "").split(",") if pair)
    spark = local_session(8, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time(); compare.spent = 0
        try:
            problem = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} spark {compare.spent:.2f}s all {time.time() - start:.2f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
