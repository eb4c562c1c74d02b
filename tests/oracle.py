"""Compare registered queries with their SQL, row by row, in DuckDB."""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def sql_bag(con, sql):
    cursor = con.execute(sql)
    return bag([d[0] for d in cursor.description], cursor.fetchall())


def main(sf_dir, only):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as registry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = registry.oracle_sql()
    for name, run in registry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            columns, got = spark_bag(run(spark, sf_dir))
        except Exception as problem:
            print(f"FAIL {name}: {str(problem)[:1500]}")
            continue
        took = time.time() - start
        if name not in sqls:
            print(f"rows {name}: {sum(got.values())} rows, {took:.1f}s")
            continue
        try:
            expected_columns, expected = sql_bag(con, sqls[name])
        except Exception as problem:
            print(f"SQL  {name}: {str(problem)[:700]}")
            continue
        if columns != expected_columns or got != expected:
            print(f"DIFF {name}: {columns} {expected_columns} {sum(got.values())} {sum(expected.values())}")
            print("   spark only", [tuple(str(v)[:200] for v in r) for r in list((got - expected))[:3]])
            print("   sql only  ", [tuple(str(v)[:200] for v in r) for r in list((expected - got))[:3]])
        else:
            print(f"ok   {name}: {sum(got.values())} rows, {took:.1f}s")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
