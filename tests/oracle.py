"""Comparison of a query's rows with those of SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def normal(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    """Column names in order, and rows as sorted tuples of text."""

    def text(v) -> str:
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        return format(float(v), ".9g") if not isinstance(v, bool) and isinstance(v, (int, float)) else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(map(text, r)) for r in df[names].itertuples(index=False))


def by_sql(sql: str, folder: str) -> pd.DataFrame:
    with duckdb.connect() as c:
        for p in Path(folder).glob("*.parquet"):
            c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        return c.sql(sql).df()
