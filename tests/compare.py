"""Runs queries on Spark and their SQL on DuckDB and compares the rows: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def compare(spark, connection, sf_dir: str, query, sql: str) -> str | None:
    """None if the rows are the same, else what differs."""
    df = query(spark, sf_dir)
    names, found = rows_of(df.columns, df.collect())
    result = connection.execute(sql)
    wanted_names, wanted = rows_of([d[0] for d in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if len(found) != len(wanted):
        return f"{len(found)} rows and {len(wanted)}"
    return next((f"{a} and {b}" for a, b in zip(found, wanted) if a != b), None)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    queries, oracles, database = entry.queries(), entry.oracle_sql(), duck(sys.argv[1])
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            verdict = compare(session, database, sys.argv[1], queries[name], oracles[name]) if name in oracles else f"{len(queries[name](session, sys.argv[1]).collect())} rows"
        except Exception as e:
            verdict = f"{type(e).__name__} {str(e)[:600]}"
        print(f"{name} {time.time() - began:.1f} s: {verdict or 'same'}", flush=True)
