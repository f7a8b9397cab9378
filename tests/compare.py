"""Run registered queries against their SQL: python tests/compare.py [sf_dir] [name...]."""

import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as e  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem documents embeddings pages benchmark"
).split()


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith(("float", "Float")):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name):
    t = time.time()
    got = e.queries()[name](spark, sf).toPandas()
    t1 = time.time()
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"{name}: rows {len(got)} ({t1 - t:.1f}s), no SQL"
    want = con.execute(sql).df()
    t2 = time.time()
    tail = f"rows {len(got)}/{len(want)} spark {t1 - t:.1f}s sql {t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: COLUMNS {sorted(got.columns)} {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) == len(b):
        bad = [
            c
            for c in a.columns
            if not (a[c].fillna("~").astype(str) == b[c].fillna("~").astype(str)).all()
            and not (a[c].dtype.kind in "fi" and (a[c].fillna(-1) == b[c].fillna(-1)).all())
        ]
        if not bad:
            return f"{name}: ok {tail}"
        c = bad[0]
        rows = (a[c].fillna("~").astype(str) != b[c].fillna("~").astype(str))
        return f"{name}: DIFF {bad} n={rows.sum()} {tail}\n{a[rows].head(3)}\n{b[rows].head(3)}"
    return f"{name}: ROWS {tail}\n{a.head(3)}\n{b.head(3)}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in sys.argv[2:] or e.queries():
        try:
            print(compare(spark, con, sf, name), flush=True)
        except Exception as ex:
            print(f"{name}: ERROR {str(ex)[:600]}", flush=True)
