"""Compare registered queries with their SQL twins: python tests/check.py [sf] [pattern] [hotGroupRows]."""

import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidepair.catalog.tables import BASE  # noqa: E402


def session(hot=None):
    b = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "12g").config("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if hot:
        spark.conf.set("spark.tidepair.hotGroupRows", str(hot))
        spark.conf.set("spark.tidepair.knnLeafRows", "20")
    return spark


def oracle_session(folder):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else v + 0.0
    return str(v)


def rows_of(names, rows):
    pos = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in pos) for r in rows]
    return sorted(out, key=lambda r: tuple(str(x) for x in r))


def compare(spark, con, folder, name):
    """None when equal, else a short description of the difference."""
    df = entry.queries()[name](spark, folder)
    got_names, got = df.columns, df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "both empty"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)}/{len(a)} rows differ, e.g.\n   {sorted(got_names)}\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    spark = session(sys.argv[3] if len(sys.argv) > 3 else None)
    folder = f"/root/testdata/sf{sf}"
    con = oracle_session(folder)
    failed = 0
    for name in entry.queries():
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            diff = "ERROR " + str(e)[:1500]
        spark.catalog.clearCache()
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("failed", failed)
