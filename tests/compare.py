"""Rows of a Spark and a DuckDB result in a form that can be compared."""

import numbers

import duckdb
import pandas as pd


def norm(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return float(value) if isinstance(value, numbers.Number) and not isinstance(value, bool) else str(value)


def rows(pdf: pd.DataFrame) -> list[str]:
    return sorted(repr(tuple(map(norm, r))) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    from pathlib import Path

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con.sql(sql).df()
