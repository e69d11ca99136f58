"""Compare registered queries with their SQL.  Usage: check_oracle.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry_points
from corpusbench.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(f"{float(value):.9g}") if abs(value) < 2**53 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    start = time.perf_counter()
    frame = entry_points.queries()[name](spark, sf_dir)
    collected = [tuple(r) for r in frame.collect()]
    spent = time.perf_counter() - start
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(collected)} rows  spark {spent:.2f}s"
    start = time.perf_counter()
    relation = connection.sql(sql)
    columns, expected = relation.columns, relation.fetchall()
    oracle_time = time.perf_counter() - start
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS spark={sorted(frame.columns)} sql={sorted(columns)}"
    mine, theirs = rows_of(frame.columns, collected), rows_of(columns, expected)
    if mine == theirs:
        note = "" if mine else "  EMPTY"
        return f"ok {len(mine)} rows  spark {spent:.2f}s  sql {oracle_time:.2f}s{note}"
    only_mine = sorted(set(mine) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(mine))[:3]
    return f"DIFF spark={len(mine)} sql={len(theirs)}\n   spark {only_mine}\n   sql   {only_theirs}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    for query_name in entry_points.queries():
        if prefixes and not query_name.startswith(prefixes):
            continue
        try:
            print(query_name, compare(session, database, folder, query_name), flush=True)
        except Exception as error:  # report and go on with the next query
            print(query_name, "ERROR", str(error)[:900], flush=True)
