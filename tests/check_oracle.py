"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from eventloom.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name):
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got[1])}", middle - started, 0.0
    rel = con.sql(sql)
    want = canonical(rel.columns, rel.fetchall())
    done = time.time()
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} {want[0]}", middle - started, done - middle
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return f"DIFFER {len(got[1])} {len(want[1])}\n  extra {extra}\n  missing {missing}", middle - started, done - middle
    return f"ok {len(got[1])}", middle - started, done - middle


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        try:
            result, mine, theirs = compare(spark, con, sf, name)
        except Exception as error:  # report and go on
            result, mine, theirs = f"ERROR {str(error)[:600]}", 0, 0
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:28s} {mine:6.2f}s {theirs:6.2f}s {result}", flush=True)
    print("bad:", bad)
