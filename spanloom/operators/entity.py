"""Deduplication and matching of records."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.sources.tables import reachable


def keep_first(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """One row a key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def preferred_or_all(df: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """Rows that match the preference; all rows of a key where none does."""
    ok = F.coalesce(preferred, F.lit(False))
    return df.withColumn("__ok", ok).withColumn("__any", F.max("__ok").over(Window.partitionBy(*keys))).where("__ok OR NOT __any").drop("__ok", "__any")


def guarded_filter(df: DataFrame, keys: list[str], keep: Column, least: int, share: float) -> DataFrame:
    """Filters a key's rows only if ``least`` of them and this share would stay; otherwise all of them stay."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    kept, total = F.count_if("__keep").over(w), F.count("*").over(w)
    return rows.withColumn("__on", (kept >= least) & (kept >= share * total)).where("__keep OR NOT __on").drop("__keep", "__on")


def disagreement(df: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    """Per key the spread (greatest less least) of each column, and whether any exceeds its limit."""
    out = df.groupBy(*keys).agg(*[(F.max(c) - F.min(c)).alias(f"{c}_spread") for c in values])
    flag = F.lit(False)
    for c, limit in values.items():
        flag = flag | F.coalesce(F.col(f"{c}_spread") > limit, F.lit(False))
    return out.withColumn("flagged", flag)


Row = dict


def extended(df: DataFrame, **more: T.DataType) -> T.StructType:
    """The schema of df with further fields; those that it has are replaced."""
    return T.StructType([f for f in df.schema if f.name not in more] + [T.StructField(n, k) for n, k in more.items()])


def in_order(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[Row]], Iterator[Row]], schema: T.StructType, batch: int = 1024) -> DataFrame:
    """Order-dependent passes: ``fold`` maps the rows of one key, one after the other in order, to rows.

    Rows are dealt by key and sorted, then stream through their task: memory is what ``fold`` carries along, however many
    rows a key has. Null keys are one key; null order values come first.
    """
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, batch) for r in b.slice(at, batch).to_pylist())
        out: list[Row] = []
        for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for r in fold(group):
                out.append(r)
                if len(out) >= batch:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    reachable(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def unbroken(rows: Iterator[Row], start: str, end: str, reach: float) -> Iterator[list[Row]]:
    """Rows in order of start, cut where one starts more than ``reach`` after all before it have ended. Rows without times
    stand alone."""
    held: list[Row] = []
    last = 0.0
    for r in rows:
        if r[start] is None or r[end] is None:
            yield [r]
            continue
        if held and r[start] > last + reach:
            yield held
            held = []
        last = max(last, r[end]) if held else r[end]
        held.append(r)
    if held:
        yield held


def drop_adjacent_repeats(df: DataFrame, keys: list[str], start: str, end: str, text: str, gap: float = 0.2) -> DataFrame:
    """Drops a row with the text of the last *kept* row if it starts within ``gap`` of that row's end. Rows without text
    or times are kept."""

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        text_kept = end_kept = None
        for r in rows:
            s, t = r[start], r[text]
            if None not in (text_kept, end_kept, s) and t == text_kept and s - end_kept <= gap:
                continue
            text_kept, end_kept = t, r[end]
            yield r

    return in_order(df, keys, [start, end], fold, df.schema)


def leader_clusters(df: DataFrame, keys: list[str], at: str, value: str, time_band: float, value_band: float) -> DataFrame:
    """Greedy clustering in order of time: a row joins the first leader within both bands, else leads a new cluster. Leaders
    go as soon as they are too old for any row to come. Rows without time or value have no cluster."""

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        leaders: deque[tuple[float, float, int]] = deque()
        n = 0
        for r in rows:
            t, v = r[at], r[value]
            if t is None or v is None:
                yield r | {"cluster": None}
                continue
            while leaders and t - leaders[0][0] > time_band:
                leaders.popleft()
            k = next((k for _, lv, k in leaders if abs(v - lv) <= value_band), None)
            if k is None:
                k = n
                leaders.append((t, v, k))
                n += 1
            yield r | {"cluster": k}

    return in_order(df, keys, [at, value], fold, extended(df, cluster=T.IntegerType()))


def push_overlaps(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.02, least: float = 0.2) -> DataFrame:
    """Rows in order of start; one that begins before the previous *edited* end + gap moves there and keeps its length,
    ``least`` at least. Rows without times stay as they are.

    A row's new start is the latest of what each row up to it leads to by its own start and the lengths and gaps since: a
    running sum, and a running maximum of start less that sum.
    """
    timed = F.col(start).isNotNull() & F.col(end).isNotNull()
    w = Window.partitionBy(*keys).orderBy(start, end)
    rows = df.where(timed).withColumn("__length", F.greatest(F.lit(least), F.col(end) - F.col(start)))
    rows = rows.withColumn("__before", F.coalesce(F.sum(F.col("__length") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("new_start", F.max(F.col(start) - F.col("__before")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__before"))
    out = rows.withColumn("new_end", F.col("new_start") + F.col("__length")).drop("__length", "__before")
    untimed = df.where(~timed).withColumns({"new_start": F.col(start).cast("double"), "new_end": F.col(end).cast("double")})
    return out.unionByName(untimed)
