"""Run registered queries against their SQL: ``python tests/check.py FOLDER [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for table in TABLES.split():
        if os.path.exists(f"{folder}/{table}.parquet"):
            connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    cursor = connection.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else float(f"{value:.9g}")
        return value

    shaped = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda row: tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row))


def compare(spark, folder: str, name: str, query, sql: str | None) -> str:
    start = time.time()
    df = query(spark, folder)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows {len(ours)} in {took:.2f}s (no SQL)"
    start = time.time()
    columns, rows = sql_rows(folder, sql)
    theirs = canonical(columns, rows)
    sql_took = time.time() - start
    timing = f"spark {took:.2f}s sql {sql_took:.2f}s"
    if sorted(columns) != sorted(df.columns):
        return f"DIFFERENT columns {sorted(df.columns)} vs {sorted(columns)}"
    if ours == theirs:
        return f"ok {len(ours)} rows, {timing}"
    only = [(a, b) for a, b in zip(ours, theirs) if a != b][:1]
    return f"DIFFERENT rows {len(ours)} vs {len(theirs)}, {timing}; first: {str(only)[:600]}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from textloom.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sqls = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        try:
            print(name, compare(spark, folder, name, query, sqls.get(name)), flush=True)
        except Exception as error:  # noqa: BLE001
            print(name, "FAILED", str(error)[:800], flush=True)


if __name__ == "__main__":
    main()
