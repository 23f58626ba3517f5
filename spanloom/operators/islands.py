"""Sessions, runs and groups of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_islands(df: DataFrame, keys: list[str], order: list[str], opens: Column, name: str = "block") -> DataFrame:
    """df with ``name``, counting from 0 the rows of a key, in order, for which ``opens`` is true (the first always is)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__opens", F.when(opens, 1).otherwise(0)).withColumn(name, F.greatest(F.lit(0), F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("__opens")


def sessions(df: DataFrame, keys: list[str], start: str, end: str, gap: float, tie: str) -> DataFrame:
    """df with ``block``: a new one begins where start lies ``gap`` or more behind the previous row's end."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    marked = df.withColumn("__gap", F.col(start) - F.lag(end).over(w))
    return number_islands(marked, keys, [start, tie], F.col("__gap") >= gap).drop("__gap")


def block_ranges(blocked: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Per block its size, the first row's start and the last row's end."""
    first, last = F.struct(start, tie), F.struct(start, tie)
    return blocked.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.min_by(start, first).alias("start"), F.max_by(end, last).alias("end"))


def chained_groups(df: DataFrame, keys: list[str], value: str, tie: str, gap: float, name: str = "row") -> DataFrame:
    """df with ``name``: values in order, a new group where one exceeds the previous by ``gap`` or more."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value, tie))
    return number_islands(df.withColumn("__step", step), keys, [value, tie], F.col("__step") >= gap, name).drop("__step")


def lane(value: Column, size: int = 40) -> Column:
    """The bucket of a whole number."""
    return F.floor(value.cast("long") / size)


def stall_runs(df: DataFrame, keys: list[str], order: str, same: list[str], eligible: Column, least: int) -> DataFrame:
    """Runs of ``least`` or more successive eligible rows that agree in the columns ``same``: first and last place and size."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("__ok", F.coalesce(eligible, F.lit(False)))
    changed = ~F.col("__ok") | ~F.coalesce(F.lag("__ok").over(w), F.lit(False))
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = rows.withColumn("__new", changed.cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = rows.where("__ok").groupBy(*keys, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("__run")


def repeated_groups(df: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """Groups of rows with equal keys, ``least`` or more: size and spread (greatest less least value)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread")).where(F.col("n") >= least)


def adjacent_pairs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row but a key's last with the value of the row after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("next_value", F.lead(value).over(w)).where(F.col("next_value").isNotNull() & F.col(value).isNotNull())


def overlap_components(df: DataFrame, keys: list[str], grace: float = 0.0) -> DataFrame:
    """df with ``component``: rows whose intervals (end extended by ``grace``) chain by overlap. On a line, components of
    the overlap graph are the islands of the running end, so no pairs are formed."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) + grace
    return number_islands(df.withColumn("__reach", reach), keys, ["start", "end"], F.col("start") > F.col("__reach"), "component").drop("__reach")


def order_blocks(df: DataFrame, keys: list[str], block: str, first: str, tie: str) -> DataFrame:
    """df with ``place``: rows ranked by their block's least ``first``, then within the block."""
    least = F.min(first).over(Window.partitionBy(*keys, block))
    w = Window.partitionBy(*keys).orderBy("__least", block, first, tie)
    return df.withColumn("__least", least).withColumn("place", F.row_number().over(w)).drop("__least")
