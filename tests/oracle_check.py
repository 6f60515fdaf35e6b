"""Compare registered plans with their SQL: python tests/oracle_check.py [name-regex] [scale]."""

from __future__ import annotations

import os
import re
import sys
import threading
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SQL_LIMIT = 40
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "null" if pd.isna(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
        return "null" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return "rows", len(got), took, ""
    t0 = time.time()
    timer = threading.Timer(SQL_LIMIT, con.interrupt)
    timer.start()
    try:
        rel = con.sql(sql)
        want, names = rel.fetchall(), rel.columns
    finally:
        timer.cancel()
    took_sql = time.time() - t0
    if sorted(df.columns) != sorted(names):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(names)}"
    a, b = canonical(got, df.columns), canonical(want, names)
    note = f"sql {took_sql:.1f}s"
    types = dict(zip(names, map(str, rel.types)))
    pairs = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if pairs.get(t) != types[c]]
    if odd:
        note += " types " + ",".join(odd)
    if a == b:
        return ("ok" if a else "EMPTY"), len(got), took, note
    sa, sb = set(a), set(b)
    extra, lack = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
    return "DIFF", len(got), took, f"{len(a)} vs {len(b)} spark-only {extra} sql-only {lack}"


def main():
    import __spark_entry__ as entry

    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    sf_dir = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    plans = entry.queries()
    if os.environ.get("SHARE"):  # one set of tables for all plans: faster, same results
        from popgraph.plans.registry import PLANS
        from popgraph.sources.tables import Tables

        shared = Tables(spark, sf_dir)
        plans = {n: (lambda s, d, p=p: p(shared)) for n, p in PLANS.items()}
    for name, fn in plans.items():
        if not pattern.search(name):
            continue
        try:
            status, rows, took, note = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:
            status, rows, took, note = "ERROR", 0, 0.0, str(exc)[:700]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += status not in ("ok", "rows")
        print(f"{status:8}{name:44}{rows:9}{took:7.1f}s  {note}", flush=True)
    print(f"{bad} not ok")


if __name__ == "__main__":
    main()
