"""Run named queries next to their SQL and compare rows, types and values.

``python tests/oracle_compare.py <sf> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA / f'sf{sf}' / t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(dtype.kind, "text")


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    """Empty text when equal, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = canonical(left), canonical(right)
    for c in a.columns:
        if a[c].isna().all() and b[c].isna().all():
            continue
        if kind(a[c].dtype) != kind(b[c].dtype):
            return f"type of {c}: {a[c].dtype} / {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{(~same).sum()} values of {c}, first {a[c][at]!r} / {b[c][at]!r}"
    return ""


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    from __spark_entry__ import oracle_sql, queries
    from loanvane.runtime import tuned_session

    spark = tuned_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
                                 "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, str(DATA / f"sf{sf}")).toPandas()
            took = time.time() - start
            verdict = f"rows only ({len(got)})"
            if name in oracles:
                verdict = compare(got, con.execute(oracles[name]).df()) or f"equal ({len(got)} rows)"
                bad += not verdict.startswith("equal")
        except Exception as err:  # noqa: BLE001
            took, verdict, bad = time.time() - start, f"ERROR {str(err)[:600]}", bad + 1
        print(f"{name:24s} {took:6.1f}s  {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
