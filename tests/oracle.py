"""Compare registered queries with their SQL on the test tables: python tests/oracle.py [prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return f"{type(v).__name__}:{v!r}"


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark, con, folder: str, fn, sql: str) -> str | None:
    df = fn(spark, folder)
    got_cols, got = bag(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = bag([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if sum(got.values()) != sum(want.values()):
        return f"rows {sum(got.values())} != {sum(want.values())}"
    if got != want:
        a, b = list((got - want).elements()), list((want - got).elements())
        return f"{len(a)} rows differ, e.g.\n    spark {sorted(a, key=str)[:3]}\n    sql   {sorted(b, key=str)[:3]}"
    if not got:
        return "no rows"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    conf = dict(kv.split("=", 1) for kv in os.environ.get("CHECK_CONF", "").split(",") if kv)
    b = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    b = b.config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, qs, sqls = duck(folder), 0, entry.queries(), entry.oracle_sql()
    for name, fn in qs.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            note = differences(spark, con, folder, fn, sqls[name]) if name in sqls else None
            if name not in sqls:
                n = len(fn(spark, folder).collect())
                note = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:900]}"
        took = time.time() - t
        if note:
            bad += 1
        if note or os.environ.get("VERBOSE"):
            print(f"{'BAD' if note else 'ok '} {name} {took:.1f}s {note or ''}", flush=True)
    print(f"{len(qs)} queries, {len(sqls)} with SQL, {bad} bad", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
