"""Run registered queries against their DuckDB texts and report differences.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .oracles import oracle_sql
from .queries import queries


def local_session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 or math.isnan(value) else value
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """First difference between both results as sets of rows, or None."""
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = _rows(expected_columns, cursor.fetchall())
    actual = _rows(df.columns, df.collect())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"{a} != {e}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, texts = local_session(), database(sf_dir), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        try:
            df = query(spark, sf_dir)
            found = difference(df, con, texts[name]) if name in texts else f"no text, {df.count()} rows"
        except Exception as error:  # report and go on with the other queries
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.perf_counter() - start:.2f}s {found or ''}", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
