"""Suppression of fragments and ghosts: rows that a stronger neighbour explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near(df: DataFrame, other: DataFrame, keys: list[str], reach: float, at: str = "start") -> DataFrame:
    """Pairs of a row of df (a.*) and one of other (b.*) with equal keys, at most ``reach`` apart in time. A row is probed
    in its own bucket of that width and the two beside it."""
    a = df.select(F.struct(*df.columns).alias("a"), F.explode(F.array(*[F.floor(F.col(at) / reach) + k for k in (-1, 0, 1)])).alias("__bucket"))
    b = other.select(F.struct(*other.columns).alias("b"), F.floor(F.col(at) / reach).alias("__bucket"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, (a["__bucket"] == b["__bucket"]) & same).where(F.abs(F.col(f"a.{at}") - F.col(f"b.{at}")) <= reach).select("a", "b")


def drop_explained(df: DataFrame, weak: Column, strong: Column, keys: list[str], row_id: str, reach: float, explains: Column | None = None) -> DataFrame:
    """df without weak rows that have a strong row of their keys within ``reach``; ``explains`` may add a condition on a and b."""
    pairs = near(df.where(weak), df.where(strong), keys, reach)
    if explains is not None:
        pairs = pairs.where(explains)
    return df.join(pairs.select(F.col(f"a.{row_id}").alias(row_id)).distinct(), row_id, "left_anti")


def repeated_shards(df: DataFrame, short: Column, keys: list[str], value: str, row_id: str, least: int, reach: float, supports: Column) -> DataFrame:
    """df without short rows of values that occur ``least`` times or more among short rows with a supporting longer row
    within ``reach``."""
    shards = near(df.where(short), df.where(~short), keys, reach).where(supports).select(F.col(f"a.{row_id}").alias(row_id), *(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{value}").alias(value)).distinct()
    clusters = shards.groupBy(*keys, value).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return df.join(shards.join(clusters, [*keys, value]).select(row_id), row_id, "left_anti")


def ban_frequent(df: DataFrame, keys: list[str], frame: str, least: int, edge: Column) -> DataFrame:
    """df without edge rows whose keys occur in ``least`` frames or more."""
    banned = df.where(edge).groupBy(*keys).agg(F.count_distinct(frame).alias("__n")).where(F.col("__n") >= least).select(*keys)
    on_edge = df.where(F.coalesce(edge, F.lit(False))).join(banned, keys, "left_anti")
    return df.where(~F.coalesce(edge, F.lit(False))).unionByName(on_edge)


def fill_gaps_of_one(df: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Rows for keys that are in frames i - 1 and i + 1 but not in i: the mean of the two values."""
    w = Window.partitionBy(*keys).orderBy(frame)
    rows = df.withColumns({"__next": F.lead(frame).over(w), "__v": F.lead(value).over(w)})
    return rows.where(F.col("__next") == F.col(frame) + 2).select(*keys, (F.col(frame) + 1).alias(frame), ((F.col(value) + F.col("__v")) / 2).alias(value))
