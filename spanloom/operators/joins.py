"""Joins by time and by ranked keys.

As-of joins are one union and one window per key (last or first value seen), so a key's rows are sorted once and never
paired; band joins go by time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in order: what a later write of the same key leaves."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """left with ``<value>_at`` and ``value`` of the right row that is nearest at or before (backward) or at or after
    (forward) its time; null if there is none, or none within ``tolerance``. right: keys, at, value. Of right rows at
    one time the least value counts."""
    back = direction == "backward"
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    told = right.groupBy(*keys, at).agg(F.min(value).alias(value)).select(*keys, F.col(at).alias("__at"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("__r"), F.lit(None).alias("__l"))
    ask = left.select(*keys, F.col(at).alias("__at"), F.lit(None).alias("__r"), F.struct(*left.columns).alias("__l"))
    both = told.withColumn("__l", F.lit(None).cast(ask.schema["__l"].dataType)).unionByName(ask.withColumn("__r", F.lit(None).cast(told.schema["__r"].dataType)))
    side = F.col("__l").isNotNull().cast("int")
    w = Window.partitionBy(*keys).orderBy("__at" if back else F.col("__at").desc(), side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__l IS NOT NULL")
    if tolerance is not None:
        found = found.withColumn("__r", F.when(F.abs(F.col("__at") - F.col("__r.at")) <= tolerance, F.col("__r")))
    return found.select("__l.*", F.col("__r.at").alias(f"{value}_at"), F.col("__r.v").alias(value))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance: float | None = None) -> DataFrame:
    """left with the right row nearest in time, before or after; the earlier one where both are as near."""
    b = as_of(left, right, keys, at, value, "backward", tolerance).withColumnsRenamed({f"{value}_at": "__b_at", value: "__b"})
    f = as_of(b, right, keys, at, value, "forward", tolerance).withColumnsRenamed({f"{value}_at": "__f_at", value: "__f"})
    before = F.col("__b_at").isNotNull() & (F.col("__f_at").isNull() | (F.col(at) - F.col("__b_at") <= F.col("__f_at") - F.col(at)))
    return f.withColumns({f"{value}_at": F.when(before, F.col("__b_at")).otherwise(F.col("__f_at")), value: F.when(before, F.col("__b")).otherwise(F.col("__f"))}).drop("__b_at", "__b", "__f_at", "__f")


def band(windows: DataFrame, points: DataFrame, keys: list[str], at: str, bucket: float, low: str = "low", high: str = "high") -> DataFrame:
    """Pairs of a window and a point of its key with low <= at < high."""
    spread = windows.where(F.col(high) > F.col(low)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    return spread.join(points.withColumn("__bucket", F.floor(F.col(at) / bucket)), [*keys, "__bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bucket")


def windows_to_next(df: DataFrame, keys: list[str], start: str, tie: str, lead_in: float, tail: float) -> DataFrame:
    """df with low and high: from ``lead_in`` before a row to the start of the next, or to ``tail`` after a key's last."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, tie))
    return df.withColumns({"low": F.col(start) - lead_in, "high": F.coalesce(following, F.col(start) + tail)})


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, span_id: str, point_id: str, bucket: float) -> DataFrame:
    """Each point with the first span (least id) that holds it, both ends included; null if none does."""
    spread = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    hit = points.withColumn("__bucket", F.floor(F.col(at) / bucket)).join(spread, [*keys, "__bucket"]).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end")))
    return points.join(hit.groupBy(point_id).agg(F.min(span_id).alias(span_id)), point_id, "left")


def best_scored(pairs: DataFrame, left_id: str, score: Column, ties: list[str]) -> DataFrame:
    """Of each left row's candidates the one with the least score; ties by the columns given."""
    w = Window.partitionBy(left_id).orderBy("__score", *ties)
    return pairs.withColumn("__score", score).withColumn("__n", F.row_number().over(w)).where("__n = 1").withColumn("score", F.col("__score")).drop("__n", "__score")


def cumulative_edits(points: DataFrame, edits: DataFrame, keys: list[str], at: str, cut: str, removed: str) -> DataFrame:
    """points with ``shift``: the sum of ``removed`` over the key's edits at or before the point. One running sum, no pairs."""
    e = edits.select(*keys, F.col(cut).alias("__at"), F.col(removed).cast("double").alias("__x"))
    p = points.select(*keys, F.col(at).alias("__at"), F.struct(*points.columns).alias("__p"))
    both = e.withColumn("__p", F.lit(None).cast(p.schema["__p"].dataType)).unionByName(p.withColumn("__x", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("__at", F.col("__p").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("shift", F.sum("__x").over(w)).where("__p IS NOT NULL").select("__p.*", "shift")


def lookup_with_fallback(left: DataFrame, right: DataFrame, exact: list[str], fallback: list[str], value: str) -> DataFrame:
    """left with ``value`` by all of ``exact``, else by ``fallback`` if just one right row has that key."""
    by_exact = right.groupBy(*exact).agg(F.min(value).alias("__exact"))
    lone = right.groupBy(*fallback).agg(F.count("*").alias("__n"), F.min(value).alias("__lone")).where("__n = 1").drop("__n")
    return left.join(by_exact, exact, "left").join(lone, fallback, "left").withColumn(value, F.coalesce("__exact", "__lone")).drop("__exact", "__lone")


def assign_by_overlap(lines: DataFrame, bags: DataFrame, keys: list[str], line: str, bag: str, token: str) -> DataFrame:
    """Per line the bag with the greatest share of the line's tokens (ties: the first bag; none: bag 0), then forward-filled
    so that it never falls. lines: keys, line, token (repeats count); bags: keys, bag, token."""
    sizes = lines.groupBy(*keys, line).agg(F.count("*").alias("n"))
    hits = lines.join(bags.select(*keys, bag, token).distinct(), [*keys, token]).groupBy(*keys, line, bag).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(*keys, line).orderBy(F.col("hits").desc(), bag)
    best = hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, line, bag, "hits")
    out = sizes.join(best, [*keys, line], "left").withColumns({bag: F.coalesce(bag, F.lit(0)), "share": F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))})
    run = Window.partitionBy(*keys).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("assigned", F.max(bag).over(run)).select(*keys, line, "share", "assigned")


def similar_tokens(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float = 0.8) -> DataFrame:
    """keys, a, b: all pairs of a key's tokens that a matching ratio of ``least`` allows, and some more; what compares the
    pairs need not look at any other. A pair may come several times.

    A ratio of 2 M / (|a| + |b|) leaves at most t = (1 - least) (|a| + |b|) characters without a partner, of which a has at
    most (t + |a| - |b|) / 2 and b at most (t + |b| - |a|) / 2. Cut into t + 1 parts, a has one that none of these touches,
    and b holds that part no more than so many places before or after where it stands in a. So tokens meet by (lengths,
    part), hashed to one number a row: no pair that shares no part is formed, but for the few of equal hashes.
    """

    def lengths(of: str, other: str) -> DataFrame:
        rows = (left if of == a else right).select(*keys, of).distinct().withColumn("__n", F.length(of))
        share = least / (2 - least)  # of the longer length that the shorter one has at least
        rows = rows.where("__n > 0").withColumn("__m", F.explode(F.sequence(F.ceil(F.col("__n") * share - 1e-9).cast("int"), F.floor(F.col("__n") / share + 1e-9).cast("int"))))
        rows = rows.withColumn("__t", F.floor((1 - least) * (F.col("__n") + F.col("__m")) + 1e-9).cast("int")).where("abs(__n - __m) <= __t")
        la, lb = ("__n", "__m") if of == a else ("__m", "__n")
        rows = rows.withColumnsRenamed({la: "__la", lb: "__lb"})
        rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__t"))))
        edge = lambda k: F.floor(k * F.col("__la") / (F.col("__t") + 1)).cast("int")
        return rows.withColumns({"__from": edge(F.col("__k")), "__size": edge(F.col("__k") + 1) - edge(F.col("__k"))}).where("__size > 0")

    place = lambda part: F.xxhash64("__la", "__lb", "__k", part)
    cut = lengths(a, b).select(*keys, a, place(F.substring(a, F.col("__from") + 1, F.col("__size"))).alias("__part"))
    less, more = (F.floor((F.col("__t") + F.col(x) - F.col(y)) / 2).cast("int") for x, y in (("__la", "__lb"), ("__lb", "__la")))
    held = lengths(b, a).withColumns({"__low": F.greatest(F.lit(0), F.col("__from") - less), "__high": F.least(F.col("__lb") - F.col("__size"), F.col("__from") + more)}).where("__low <= __high")
    parts = F.array_distinct(F.transform(F.sequence("__low", "__high"), lambda at: F.substring(b, at + 1, F.col("__size"))))
    held = held.withColumn("__text", F.explode(parts)).select(*keys, b, place(F.col("__text")).alias("__part"))
    # both sides are far larger than what they are made of, so neither is sent to all tasks
    return cut.join(held.hint("merge"), [*keys, "__part"]).select(*keys, a, b)
