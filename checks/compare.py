"""Run the named queries and compare them with their SQL forms in DuckDB.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.duckdb_sql import all_sql
from checks.catalog import all_queries
from spendtrace.session import drop_intermediate, local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "M":
            frame[c] = frame[c].astype("datetime64[us]")
        elif str(frame[c].dtype) == "Int64" and frame[c].isna().any():
            frame[c] = frame[c].astype("float64")  # as Spark hands over integers with nulls
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    a, b = normal(spark_frame), normal(sql_frame)
    if list(a.columns) != list(b.columns):
        return [f"columns {list(a.columns)} / {list(b.columns)}"]
    if len(a) != len(b):
        return [f"rows {len(a)} / {len(b)}"]
    found = []
    for c in a.columns:
        if a[c].dtype != b[c].dtype:
            found.append(f"{c}: type {a[c].dtype} / {b[c].dtype}")
        different = (a[c] != b[c]) & ~(a[c].isna() & b[c].isna())
        if different.any():
            i = different.idxmax()
            found.append(f"{c}: {int(different.sum())} values, {a[c][i]!r} / {b[c][i]!r}")
    return found


def main(folder: str, names: list[str]) -> int:
    spark = local_session()
    connection, sql, failed = connect(folder), all_sql(), 0
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            frame = query(spark, folder).toPandas()
            took = time.time() - started
            found = differences(frame, connection.sql(sql[name]).df()) if name in sql else []
            size = len(frame)
        except Exception as error:  # report and go on with the next query
            found, took, size = [str(error)[:600]], time.time() - started, 0
        failed += bool(found)
        mark = "DIFF" if found else ("ok" if name in sql else "rows")
        print(f"{mark:5} {name:28} {size:8} rows {took:6.2f} s {time.time()-started-took:6.2f}",
              *found, flush=True)
    drop_intermediate(spark)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
