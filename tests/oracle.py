"""Runs queries next to their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(x) -> str:
        if x is None or x != x:
            return "NULL"
        if isinstance(x, bool):
            return str(x)
        return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)

    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def compare(spark, con, build, sql: str, sf_dir: str) -> str:
    """Empty text when both results are equal."""
    sdf = build(spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns, dtype=object)
    rel = con.sql(sql)
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    off = {n: (k, types[n]) for n, k in sdf.dtypes if kinds.get(k) != types[n]}
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "no rows"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(diff)} rows differ: {only_a} / {only_b}"
    return f"types {off}" if off else ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, entry.queries()[name], oracles[name], sf_dir)
            else:
                result = "" if entry.queries()[name](spark, sf_dir).count() else "no rows"
        except Exception as failure:  # noqa: BLE001
            result = f"{type(failure).__name__}: {str(failure)[:600]}"
        bad += bool(result)
        print(f"{'ok  ' if not result else 'FAIL'} {name} {time.time() - start:.1f}s {result}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
