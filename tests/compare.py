"""Run the catalogue against DuckDB: ``python tests/compare.py [folder] [names…]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> str | None:
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    want = normal(expected.fetchall(), names)
    got = normal([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"{mine} instead of {theirs}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = oracle_connection(folder), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            problem = differences(df, con, oracle[name]) if name in oracle else f"no oracle, {df.count()} rows"
        except Exception as error:  # report and go on
            problem = "ERROR " + str(error)[:600]
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'same'}", flush=True)
    print(f"{bad} differ")
