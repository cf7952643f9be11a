"""Compare every query with its SQL on one folder: python tests/check_oracles.py [folder] [names..]"""

import datetime as dt
import glob
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def main(folder="/root/testdata/sf0.01", *names):
    import __spark_entry__ as entry
    spark, con = session(), duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    queries, sqls, bad = entry.queries(), entry.oracle_sql(), []
    for name in names or queries:
        try:
            t = time.time()
            df = queries[name](spark, folder)
            got = rows(df.columns, df.collect())
            spent = time.time() - t
            if name not in sqls:
                print(f"rows  {name}: {len(got)} rows, {spent:.1f} s", flush=True)
                continue
            t = time.time()
            rel = con.execute(sqls[name])
            cols = [d[0] for d in rel.description]
            want = rows(cols, rel.fetchall())
            ok = sorted(cols) == sorted(df.columns) and got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)} rows, {spent:.1f} s (sql {time.time() - t:.1f} s)", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", sorted(df.columns), sorted(cols), "rows", len(got), len(want))
                a, b = set(got), set(want)
                print("   only spark", [x[:600] for x in sorted(a - b)[:3]])
                print("   only sql  ", [x[:600] for x in sorted(b - a)[:3]])
        except Exception:
            bad.append(name)
            print("FAIL ", name, "\n".join(traceback.format_exc().splitlines()[-12:])[:1800], flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
