"""Compare registered queries with their reference SQL in DuckDB.

usage: python tools/check.py SF [name-part ...]
"""

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session():
    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-Dlog4j2.level=ERROR")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "NaN" if math.isnan(f) else f + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def types(columns, kinds):
    return dict(zip(columns, kinds))


def main():
    from gaugewright.catalog import ORACLES, QUERIES

    folder = f"/root/testdata/sf{sys.argv[1]}"
    parts = sys.argv[2:]
    spark, con = session(), duck(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got_cols, got = rows(df.columns, df.collect())
            took = time.time() - start
            if name not in ORACLES:
                print(f"ROWS {name:28s} {len(got):8d} {took:6.2f}s", flush=True)
                continue
            t1 = time.time()
            cur = con.execute(ORACLES[name])
            want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
            t_duck = time.time() - t1
            spark_types = dict(df.dtypes)
            duck_types = {d[0]: str(d[1]) for d in cur.description}
            if got_cols != want_cols:
                bad += 1
                print(f"FAIL {name} columns {got_cols} != {want_cols}", flush=True)
            elif got != want:
                bad += 1
                diff = [(g, w) for g, w in zip(got, want) if g != w]
                print(f"FAIL {name} rows {len(got)} vs {len(want)}, {len(diff)} differ", flush=True)
                for g, w in diff[:3]:
                    print("   spark", g, "\n   duck ", w)
            else:
                odd = {c: (spark_types[c], duck_types[c]) for c in got_cols if not same_type(spark_types[c], duck_types[c])}
                print(f"ok   {name:28s} {len(got):8d} {took:6.2f}s duck {t_duck:5.2f}s {odd or ''}", flush=True)
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {str(e)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)


def same_type(s, d):
    pairs = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]",
    }
    return pairs.get(s) == d


if __name__ == "__main__":
    main()
