"""What the query modules share: registration and the tables as intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The events as points (tm, in seconds) and as intervals (start, end), in SQL.
E = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) / 1e6 AS tm FROM events)"
S = E + """, s AS (SELECT event_id, user_id, event_type, value, tm AS "start", tm + value * 360 AS "end" FROM e)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def seconds(ts: str = "ts") -> Column:
    """A timestamp without zone as seconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 1e6


def points(spark: SparkSession, d: str) -> DataFrame:
    """Events with ``at`` in seconds."""
    return table(spark, d, "events").withColumn("at", seconds()).drop("ts")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals: value * 360 seconds from their time on."""
    return points(spark, d).select("event_id", "user_id", "event_type", "value", F.col("at").alias("start"), (F.col("at") + F.col("value") * 360).alias("end"))


def of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("event_type") == kind)


def rounded(df: DataFrame, places: int = 4, *names: str) -> DataFrame:
    """df with its double columns (or those named) rounded, so that sums taken in another order compare equal."""
    chosen = names or [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, places) for c in chosen})
