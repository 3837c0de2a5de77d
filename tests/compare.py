"""Run queries next to their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def rows(df, *order):
    """Rows as tuples, sorted by the given columns."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def difference(spark, con, query, sql, sf_dir):
    """Why a query and its SQL differ, or None."""
    df = query(spark, sf_dir)
    left = canonical(df.columns, df.collect())
    if sql is None:
        return None if left else "no rows"
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    right = canonical(names, found.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows instead of {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{a} instead of {b}"
    return None if left else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as spec

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sqls = connect(sf_dir), spec.oracle_sql()
    for name, query in spec.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            problem = difference(spark, con, query, sqls.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        print(f"{name:28} {time.time() - start:6.2f}s {'ok' if problem is None else 'DIFFERS ' + problem[:500]}", flush=True)


if __name__ == "__main__":
    main()
