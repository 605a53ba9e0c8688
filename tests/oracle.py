"""Compare registered queries with their SQL on DuckDB: names, row counts and exact values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
DATA = os.environ.get("RIGSPARK_TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, repr(float(v) + 0.0))
    return (3, str(v))


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def spark_rows(df):
    cols = df.columns
    return rows_of(cols, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    got = spark_rows(df)
    want = duck_rows(con, sql)
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rigspark.session import local_session

    sf = next((a.split("=")[1] for a in argv if a.startswith("sf=")), "0.01")
    names = [a for a in argv if "=" not in a]
    sf_dir = f"{DATA}/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf_dir)
                kind = "SQL"
            else:
                n = queries[name](spark, sf_dir).count()
                problem, kind = (None if n > 0 else "no rows"), f"rows {n}"
        except Exception as e:  # noqa: BLE001
            problem, kind = f"{type(e).__name__}: {str(e)[:1500]}", "error"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} [{kind}] {time.time() - start:.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
