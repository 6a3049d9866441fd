"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(names: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when the rows agree, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    types = {c[0]: str(c[1]) for c in result.description}
    wanted_names, wanted = rows_of([c[0] for c in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [f"{c}: {t} != {types[c]}" for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    if off:
        return f"types {off}"
    if got != wanted:
        left, right = set(got) - set(wanted), set(wanted) - set(got)
        return f"{len(got)} rows, {len(wanted)} wanted; only here {sorted(left)[:3]}; only there {sorted(right)[:3]}"
    return None


if __name__ == "__main__":
    from loomprep import build_session

    session = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                            spark__driver__memory="8g")
    session.sparkContext.setLogLevel("OFF")
    folder = sys.argv[1]
    chosen = sys.argv[2:] or list(contract.queries())
    db = connect(folder)
    failed = 0
    for query in chosen:
        start = time.time()
        try:
            problem = compare(session, db, query, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {query} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {failed} failed")
