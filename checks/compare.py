"""Run the registered queries against their oracles: ``python -m checks.compare``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLES
from checks.registry import QUERIES

VIEWS = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in VIEWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    rows = [
        tuple(None if pd.isna(v) else (v if isinstance(v, (str, bool)) else float(v)) for v in row)
        for row in df.itertuples(index=False)
    ]
    return pd.DataFrame(sorted(rows, key=repr), columns=df.columns, dtype=object)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """The first way in which two results differ, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = _plain(got), _plain(want)
    for i, (a, b) in enumerate(zip(got.values.tolist(), want.values.tolist(), strict=True)):
        if a != b:
            return f"row {i}: {a} != {b} in {list(got.columns)}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in only or QUERIES:
        started = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in ORACLES:
                print(f"{took:6.2f}s {name}: {len(got)} rows, no oracle", flush=True)
                continue
            problem = difference(got, con.execute(ORACLES[name]).df())
        except Exception as error:  # report and go on with the next query
            took, problem = time.time() - started, f"{type(error).__name__}: {str(error)[:600]}"
            got = []
        bad += problem is not None
        print(f"{took:6.2f}s {name}: {problem or f'ok {len(got)} rows'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
