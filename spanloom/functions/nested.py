"""Arrays, maps and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_map(m: Column) -> Column:
    """The map with its entries in order of key."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def nest(df: DataFrame, keys: list[str], order: str, fields: list[str], name: str = "items", places: int = 3) -> DataFrame:
    """A row per key with an array of structs in order; doubles are rounded. For bounded groups (a document's lines)."""
    kinds = dict(df.dtypes)
    parts = [F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in fields]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), *parts))).alias(name))


def unnest_words(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row per word with the places of its line and itself; blank lines count but give no rows."""
    lines = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_idx", "line"))
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    return lines.select(*keys, "line_idx", F.posexplode(words).alias("word_idx", "word"))


def first_content_token(tokens: Column, least: int = 3) -> Column:
    """The first token of ``least`` characters or more; null if there is none."""
    return F.try_element_at(F.filter(tokens, lambda t: F.length(t) >= least), F.lit(1))


def shift_to_window(df: DataFrame, start: str, end: str, low: Column, length: Column, slack: float = 0.5) -> DataFrame:
    """Times relative to ``low``; rows that lie outside [0, length + slack] go."""
    moved = df.withColumns({start: F.col(start) - low, end: F.col(end) - low})
    return moved.where((F.col(end) > 0) & (F.col(start) <= length + slack))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
