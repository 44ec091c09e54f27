"""Runs registered queries and their SQL side by side."""

import datetime
import decimal
import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Spark's name of a type, and DuckDB's.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "binary": "BLOB", "timestamp_ntz": "TIMESTAMP"}


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}") + 0.0
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if isinstance(x, dict):
        return tuple(plain(i) for i in x.values())
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """What differs between a query's result and its SQL's, or nothing."""
    found = con.sql(sql)
    want, kinds = found.fetchall(), dict(zip(found.columns, map(str, found.types)))
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} and {sorted(found.columns)}"
    wrong = {c: (k, kinds[c]) for c, k in df.dtypes if TYPES.get(k, kinds[c]) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    a, b = rows_of(df.columns, df.collect()), rows_of(list(found.columns), want)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only in one: {only}"
    return ""


if __name__ == "__main__":
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    names = [n for n in entry.queries() if any(n.startswith(p) for p in sys.argv[2:] or [""])]
    for n in names:
        try:
            df = entry.queries()[n](spark, folder)
            said = differences(df, con, entry.oracle_sql()[n]) if n in entry.oracle_sql() else f"rows only: {df.count()}"
        except Exception as e:  # a report, not a test
            said = f"{type(e).__name__}: {str(e)[:300]}"
        bad += bool(said) and not said.startswith("rows only")
        if said:
            print(n, said[:700])
    print(len(names), "queries,", bad, "bad")
