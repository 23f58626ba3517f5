"""Window operators over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot_durations(df: DataFrame, keys: list[str], start: str, tie: str, end: Column) -> DataFrame:
    """df with ``slot``: time to the next row, at least 0; for a key's last row, to ``end``."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, tie))
    return df.withColumn("slot", F.greatest(F.lit(0.0), F.coalesce(following - F.col(start), end - F.col(start))))


def capped_ends(df: DataFrame, keys: list[str], start: str, tie: str, longest: float = 10.0, capped: float = 5.0, last: float = 3.0) -> DataFrame:
    """df with ``end_at``: the next row's start; start + capped if that is more than ``longest`` away; start + last at the end."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, tie))
    end = F.when(following.isNull(), F.col(start) + last).when(following - F.col(start) > longest, F.col(start) + capped).otherwise(following)
    return df.withColumn("end_at", end)


def spread_words(df: DataFrame, text: str, start: str, end: str, fill: float = 0.95) -> DataFrame:
    """A row per word of ``text``: word i of n starts at start + i * d / n and lasts d * fill / n, d being the length."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    d = F.col(end) - F.col(start)
    rows = df.withColumn("__n", F.size(words)).select("*", F.posexplode(words).alias("word_idx", "word"))
    begin = F.col(start) + F.col("word_idx") * d / F.col("__n")
    return rows.withColumns({"word_start": begin, "word_end": begin + d * fill / F.col("__n")}).drop("__n")


def drop_consecutive_duplicates(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__same", F.col(value).eqNullSafe(before) & before.isNotNull()).where("NOT __same").drop("__same")


def order_violations(df: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """Rows that start before the row before them (out_of_order) or end before they start (negative)."""
    before = F.lag(start).over(Window.partitionBy(*keys).orderBy(order))
    issue = F.when(F.col(end) < F.col(start), "negative").when(F.col(start) < before, "out_of_order")
    return df.withColumn("issue", issue).where("issue IS NOT NULL")


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 5) -> DataFrame:
    """df with ``smooth``: the mean of this and the rows before it, ``rows`` at most, cut to a whole number."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("smooth", F.avg(value).over(w).cast("int"))


def recent_drift(df: DataFrame, keys: list[str], order: str, offset: str, rows: int = 5, least: float = 0.5, trust: float = 1.0) -> DataFrame:
    """df with ``drift``: the mean of the non-trivial offsets (absolute value over ``least``) among the last rows, if there
    are two and the mean exceeds ``trust`` in absolute value; else 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    big = F.when(F.abs(F.col(offset)) > least, F.col(offset))
    mean, n = F.avg(big).over(w), F.count(big).over(w)
    return df.withColumn("drift", F.when((n >= 2) & (F.abs(mean) > trust), mean).otherwise(0.0))


def never_falling(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with ``name``: the greatest value so far."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def close_gaps(df: DataFrame, keys: list[str], start: str, end: str, tie: str, longest: float) -> DataFrame:
    """Moves rows earlier so that no gap to the row before exceeds ``longest``; shifts add up along the key."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    over = F.greatest(F.lit(0.0), F.col(start) - F.lag(end).over(w) - longest)
    rows = df.withColumn("__over", F.coalesce(over, F.lit(0.0)))
    shift = F.sum("__over").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"new_start": F.col(start) - shift, "new_end": F.col(end) - shift}).drop("__over")


def redistribute(df: DataFrame, keys: list[str], order: str, weight: str, total: Column) -> DataFrame:
    """df with ``share_start`` and ``share_end``: ``total`` dealt out along the key in proportion to positive weights;
    a key without weight is dealt evenly."""
    w = Window.partitionBy(*keys)
    sums, n = F.sum(weight).over(w), F.count("*").over(w)
    part = F.when(sums > 0, F.col(weight) / F.when(sums > 0, sums)).otherwise(1 / n) * total
    rows = df.withColumn("__part", part)
    upto = F.sum("__part").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"share_start": upto - F.col("__part"), "share_end": upto}).drop("__part")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """df with the running number of each row of a key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def interpolate_between_anchors(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with ``filled``: null values on the line between the nearest known rows before and after; beyond the first and
    last known row they take its value."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("o"), F.col(value).cast("double").alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = df.withColumns({"__a": before, "__b": after})
    width = F.col("__b.o") - F.col("__a.o")
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(order) - F.col("__a.o")) / F.when(width != 0, width)
    return rows.withColumn("filled", F.coalesce(F.col(value).cast("double"), line, F.col("__a.v"), F.col("__b.v"))).drop("__a", "__b")


def sustained_onset(df: DataFrame, keys: list[str], order: str, value: str, hold: int = 3, lead: int = 5, factor: float = 3.5, floor: float = 1.0) -> DataFrame:
    """Per key the first row from which ``hold`` rows lie above a threshold: values less the mean of the first ``lead``
    rows, in absolute terms, against median + max(floor, factor * median absolute deviation). Null if none."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, F.col(value).cast("double").alias("v")).withColumn("__r", F.row_number().over(w))
    base = rows.where(F.col("__r") <= lead).groupBy(*keys).agg(F.avg("v").alias("base"))
    d = rows.join(base, keys).withColumn("d", F.abs(F.col("v") - F.col("base")))
    med = d.groupBy(*keys).agg(F.expr("percentile(d, 0.5)").alias("med"))
    mad = d.join(med, keys).groupBy(*keys).agg(F.max("med").alias("med"), F.expr("percentile(abs(d - med), 0.5)").alias("mad"))
    t = d.join(mad, keys).withColumn("up", (F.col("d") > F.col("med") + F.greatest(F.lit(floor), factor * F.col("mad"))).cast("int"))
    ahead = w.rowsBetween(0, hold - 1)
    t = t.withColumns({"low": F.min("up").over(ahead), "n": F.count("*").over(ahead)})
    return t.groupBy(*keys).agg(F.min(F.when((F.col("low") == 1) & (F.col("n") == hold), F.col(order))).alias("onset"))
