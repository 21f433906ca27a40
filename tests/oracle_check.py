"""Compare catalog queries with their SQL: ``python tests/oracle_check.py [folder] [query …]``."""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def normal(value):
    """Values of both engines in one form that can be sorted."""
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "nan")
    return (2, repr(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def connect(folder):
    connection = duckdb.connect()
    for name in ("pages", "documents", "labels"):
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def compare(df, connection, sql):
    """None when both agree, else what differs."""
    ours = df.collect()
    relation = connection.sql(sql)
    theirs = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    ours, theirs = rows_of(df.columns, ours), rows_of(relation.columns, theirs)
    if ours != theirs:
        first = next((pair for pair in zip(ours, theirs) if pair[0] != pair[1]), None)
        return f"{len(ours)} / {len(theirs)} rows, first difference {str(first)[:600]}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}
    wrong = [(n, t, types[n]) for n, t in df.dtypes if names.get(t) != types[n]]
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("NO_BROADCAST"):  # the plans that tables too big to broadcast get
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    connection = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = compare(query(spark, folder), connection, oracles[name])
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    print("differences:", bad, "without SQL:", sorted(set(entry.queries()) - set(oracles)))
