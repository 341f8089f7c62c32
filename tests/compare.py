"""Runs queries beside their SQL twins: python tests/compare.py [-d DIR] NAME_PREFIX..."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    if isinstance(v, Decimal):
        return ("decimal", float(v))
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, d, name, make, twin):
    df = make(spark, d)
    ours = rows_of(df.columns, df.collect())
    if twin is None:
        return len(ours), "rows only"
    cur = con.execute(twin)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(ours), f"columns {sorted(df.columns)} {sorted(names)}"
    if ours == theirs:
        return len(ours), "equal"
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return len(ours), f"DIFFERS: {len(ours)} and {len(theirs)} rows; only here {len(a)}: {sorted(a, key=repr)[:2]}; only there {len(b)}: {sorted(b, key=repr)[:2]}"


def connect(d):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{d}/{f}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    d = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        d, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    for name, make in entry.queries().items():
        if not args or any(name.startswith(a) for a in args):
            began = time.time()
            try:
                n, said = compare(spark, con, d, name, make, entry.oracle_sql().get(name))
            except Exception as e:
                n, said = -1, f"ERROR {str(e)[:1500]}"
            print(f"{name}: {n} rows, {time.time() - began:.1f} s, {said}", flush=True)
    os._exit(0)
