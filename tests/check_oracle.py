"""Run registered queries beside their SQL: python -m tests.check_oracle [sf_dir] [name ...]"""
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return repr(round(v, 6))
        if v.__class__.__name__ == "Decimal":
            return repr(round(float(v), 6)) if v % 1 else str(int(v))
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(sf="/root/testdata/sf0.01", *names):
    import tempfile

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sqls = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            cols, got = canonical([tuple(r) for r in df.collect()], df.columns)
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in sqls:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            res = db.execute(sqls[name])
            want_cols, want = canonical(res.fetchall(), [d[0] for d in res.description])
        except Exception as e:
            bad += 1
            print(f"SQL  {name}: {str(e)[:400]}", flush=True)
            continue
        if (cols, got) == (want_cols, want):
            print(f"ok   {name}: {len(got)} rows, {took:.1f}s", flush=True)
        else:
            bad += 1
            print(f"DIFF {name}: {cols} {want_cols} {len(got)} / {len(want)} rows, {took:.1f}s", flush=True)
            only = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
            print("   spark", only[0], "\n   sql  ", only[1], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
