"""Order-dependent passes that carry more than one row along: over two inputs at once, over clusters with running medians,
and over chains of options."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappush, heappushpop
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.sources.tables import reachable

from .entity import Row, extended, in_order

Event = tuple[bool, Row]


def co_ordered(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, fold: Callable[[Iterator[Event]], Iterator[Row]], schema: T.StructType, batch: int = 1024) -> DataFrame:
    """``in_order`` over two inputs: ``fold`` maps the rows of one key of both, merged in order, to rows.

    It gets (is of the left input, row) by ``left_at`` and ``right_at``, right rows first among equals, then by all their
    columns, so that the order is the same in every run. A left row that needs right rows up to some reach ahead is given
    a ``left_at`` that much later. Memory is what ``fold`` carries along. Null times come first; null keys are one key.
    """
    side = lambda df, at, own, other: df.select(*keys, at.alias("__at"), F.lit(own == "__left").alias("__is_left"), F.struct(*df.columns).alias(own)).withColumn(other, F.lit(None))
    both = side(left, left_at, "__left", "__right").unionByName(side(right, right_at, "__right", "__left"))
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, batch) for r in b.slice(at, batch).to_pylist())
        out: list[Row] = []
        for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for r in fold((e["__is_left"], e["__left"] if e["__is_left"] else e["__right"]) for e in group):
                out.append(r)
                if len(out) >= batch:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    reachable(left.sparkSession)
    return both.repartition(*keys).sortWithinPartitions(*keys, "__at", "__is_left", "__left", "__right").mapInArrow(run, schema)


class Median:
    """A running median: the lower half in a heap with its greatest in front, the upper half with its least."""

    def __init__(self):
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, x: float) -> None:
        if len(self.low) > len(self.high):
            heappush(self.high, -heappushpop(self.low, -x))
        else:
            heappush(self.low, -heappushpop(self.high, x))

    @property
    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def median_clusters(df: DataFrame, keys: list[str], start: str, end: str, y: str, start_band: float = 2.0, end_band: float = 3.0) -> DataFrame:
    """df with ``cluster``: in order of start, then y, a row joins the first cluster whose median start and median end are
    within the bands of its own, else it begins one. Clusters are numbered in the order in which they begin.

    Starts rise, and a median moves only when a row joins, so a cluster whose median start has fallen behind the band is
    never joined again and goes: what is carried along is the clusters within the band. Rows without times have no cluster.
    """

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        live: list[tuple[int, Median, Median]] = []
        begun = 0
        for r in rows:
            s, e = r[start], r[end]
            if s is None or e is None:
                yield r | {"cluster": None}
                continue
            live = [c for c in live if s - c[1].value <= start_band]
            found = next((c for c in live if abs(s - c[1].value) <= start_band and abs(e - c[2].value) <= end_band), None)
            if found is None:
                found = begun, Median(), Median()
                live.append(found)
                begun += 1
            found[1].add(s)
            found[2].add(e)
            yield r | {"cluster": found[0]}

    return in_order(df, keys, [start, y, end], fold, extended(df, cluster=T.IntegerType()))


def assign_onsets(words: DataFrame, onsets: DataFrame, keys: list[str], start: str, place: str, at: str, most: float = 2.0, worst: float = 3.0, early: float = 0.5, late_penalty: float = 2.0, rest: float = 0.3) -> DataFrame:
    """words with ``onset``: the times that onsets of the same key give them, one to one and in order; null where none fits.

    Words go in order of start, then place. Each takes the nearest of the onsets not passed yet (the first of equals); one
    more than ``early`` before the word counts as ``late_penalty`` further away. It must be within ``most``, or, where
    fewer onsets are left behind it than words, score below ``worst``. Onsets up to ``rest`` after the one taken are passed
    as well. A word waits for the onsets ``worst`` after it, and those too far before it are dropped, so onsets within a
    few seconds are all that is held. Words without a start, and keys without onsets, get none.
    """
    back = worst - late_penalty  # an onset this far before a word, or further, never scores below ``worst``
    count = lambda df: F.count("*").over(Window.partitionBy(*keys))
    timed = words.where(F.col(start).isNotNull())
    left = timed.withColumns({"__n": count(timed), "__i": F.row_number().over(Window.partitionBy(*keys).orderBy(start, place))})
    known = onsets.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("__at"))
    right = known.withColumns({"__n": count(known), "__j": F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))})
    names = words.columns

    def fold(events: Iterator[Event]) -> Iterator[Row]:
        held: deque[tuple[float, int]] = deque()  # time, onsets behind it
        passed = float("-inf")
        for is_word, r in events:
            if not is_word:
                if r["__at"] >= passed:
                    held.append((r["__at"], r["__n"] - r["__j"]))
                continue
            expected, behind = r[start], r["__n"] - r["__i"]
            while held and expected - held[0][0] >= max(back, early):
                held.popleft()
            best, score = None, worst
            for o, left_ in held:
                far = abs(o - expected) + (late_penalty if o < expected - early else 0.0)
                if far < score and (far <= most or 0 < behind and left_ < behind):
                    best, score = o, far
            if best is not None:
                passed = best + rest
                while held and (held[0][0] <= best or held[0][0] < passed):
                    held.popleft()
            yield {c: r[c] for c in names} | {"onset": best}

    found = co_ordered(left, right, keys, F.col(start) + worst, F.col("__at"), fold, extended(words, onset=T.DoubleType()))
    untimed = words.where(F.col(start).isNull()).withColumn("onset", F.lit(None).cast("double"))
    return found.unionByName(untimed.select(*found.columns))


def filled_starts(words: DataFrame, keys: list[str], start: str, end: str, place: str, chars: str, gap: float = 0.02, least: float = 0.1) -> DataFrame:
    """words with new_start and new_end from ``onset`` (see assign_onsets), in order of start, then place.

    A word without an onset stands before the next one that has one by the lengths estimated for it and those between
    (0.08 seconds a character, 0.15 to 0.5). The last word without one follows the onset just before it, or keeps its
    start. Starts that don't rise stand a tenth of a second after the one before. A word ends ``gap`` before the next
    start, the last one at its own end, and lasts ``least``. Words without a start are left out.
    """
    w = Window.partitionBy(*keys).orderBy(start, place)
    length = F.greatest(F.lit(0.15), F.least(F.lit(0.5), 0.08 * F.col(chars)))
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = words.where(F.col(start).isNotNull()).withColumn("__length", length).withColumns({"__before": F.coalesce(F.sum("__length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "__next": F.lead(start).over(w), "__lag": F.lag("onset").over(w), "__lag_length": F.lag("__length").over(w)})
    fixed = F.coalesce("onset", F.when(F.col("__next").isNull(), F.coalesce(F.col("__lag") + F.col("__lag_length"), F.col(start))))
    rows = rows.withColumn("__fixed", fixed)
    target = F.first(F.when(F.col("__fixed").isNotNull(), F.struct("__fixed", "__before")), ignorenulls=True).over(ahead)
    rows = rows.withColumn("__target", target).withColumn("new_start", F.col("__target.__fixed") - (F.col("__target.__before") - F.col("__before"))).select(*words.columns, "new_start")

    def rising(group: Iterator[Row]) -> Iterator[Row]:
        last = None
        for r in group:
            last = r["new_start"] if last is None or r["new_start"] > last else last + 0.1
            yield r | {"new_start": last}

    out = in_order(rows, keys, [start, place], rising, rows.schema)
    ends = F.coalesce(F.lead("new_start").over(w) - gap, F.col(end))
    return out.withColumn("new_end", F.greatest(ends, F.col("new_start") + least))


def chained(options: DataFrame, keys: list[str], place: str, choice: str, cost: str, anchor: str | None = None, grace: int = 1, base: float = 0.55, step: float = 0.14) -> DataFrame:
    """keys, place, choice: for each place one of its options, so that the costs and the penalties for going back are least.

    After choice p, choice c costs nothing more if c >= p - grace, else base + step * (p - grace - c). Of equal sums
    that with the least choice at the last place counts, then at the one before it. A place with an option that ``anchor`` marks keeps the cheapest of those: it is settled
    first, and the places between two anchors are a window of their own, with both anchors at its ends; windows are solved
    side by side. Within one a dynamic program goes over the options in order of choice: going forward costs the same from
    all choices up to c + grace, so each place takes time in proportion to its options, sorted, not to their pairs. Rows
    without place, choice or cost count for nothing.
    """
    mark = F.coalesce(F.col(anchor), F.lit(False)) if anchor else F.lit(False)
    rows = options.select(*keys, F.col(place).alias("__place"), F.struct(F.col(cost).cast("double").alias("cost"), F.col(choice).cast("long").alias("choice")).alias("o"), mark.alias("m")).where("__place IS NOT NULL AND o.cost IS NOT NULL AND o.choice IS NOT NULL")
    lists = rows.groupBy(*keys, "__place").agg(F.min(F.when(F.col("m"), F.col("o"))).alias("fixed"), F.collect_set("o").alias("all"))
    order = Window.partitionBy(*keys).orderBy("__place")
    lists = lists.select(*keys, "__place", F.when(F.col("fixed").isNotNull(), F.array("fixed")).otherwise(F.col("all")).alias("all"), F.col("fixed").isNotNull().alias("first")).withColumn("window", F.sum(F.col("first").cast("int")).over(order))
    # an anchor begins its window and, without being given out again, ends the one before
    ends = lists.where("first AND window > 0").select(*keys, "__place", "all", F.lit(False).alias("own"), (F.col("window") - 1).alias("window"))
    dealt = lists.select(*keys, "__place", "all", F.lit(True).alias("own"), "window").unionByName(ends)

    def fold(places: Iterator[Row]) -> Iterator[Row]:
        held: list[tuple[Row, list[int], list[int | None]]] = []  # row, choices, which option came before
        totals: list[float] = []
        for r in places:
            now = cheapest_each(r["all"])
            came, new = forward([c for c, _ in now], held[-1][1] if held else [], totals, grace, base, step)
            totals = [x + k for x, (_, k) in zip(new, now, strict=True)]
            held.append((r, [c for c, _ in now], came))
        at = min(range(len(totals)), key=totals.__getitem__) if totals else 0
        out = []
        for r, choices, came in reversed(held):
            if r["own"]:
                out.append({k: r[k] for k in keys} | {"__place": r["__place"], "choice": choices[at]})
            at = came[at]
        yield from reversed(out)

    fields = T.StructType([*(f for f in dealt.schema if f.name in keys), T.StructField("__place", dealt.schema["__place"].dataType), T.StructField("choice", T.LongType())])
    return in_order(dealt, [*keys, "window"], ["__place"], fold, fields).withColumnRenamed("__place", place)


def cheapest_each(options: list[dict]) -> list[tuple[int, float]]:
    """(choice, cost) in order of choice, each once."""
    best: dict[int, float] = {}
    for o in options:
        best[o["choice"]] = min(o["cost"], best.get(o["choice"], o["cost"]))
    return sorted(best.items())


def forward(now: list[int], before: list[int], totals: list[float], grace: int, base: float, step: float) -> tuple[list, list[float]]:
    """For each choice (rising) the option before it with the least total and penalty, and that sum; the first of equals.

    Choices up to c + grace cost their totals: the least of a prefix. Those beyond cost totals + base + step * (p - grace
    - c): the least of a suffix, with totals + step * p in place of totals.
    """
    if not before:
        return [None] * len(now), [0.0] * len(now)
    least: list[int] = []
    for k in range(len(before)):
        least.append(k if not least or totals[k] < totals[least[-1]] else least[-1])
    slope, beyond = [t + step * p for t, p in zip(totals, before, strict=True)], [0] * len(before)
    for k in reversed(range(len(before))):
        beyond[k] = k if k == len(before) - 1 or slope[k] <= slope[beyond[k + 1]] else beyond[k + 1]
    came, sums, reach = [], [], 0
    for c in now:
        while reach < len(before) and before[reach] <= c + grace:
            reach += 1
        ways = [(totals[least[reach - 1]], least[reach - 1])] if reach else []
        if reach < len(before):
            ways.append((slope[beyond[reach]] + base - step * (grace + c), beyond[reach]))
        total, k = min(ways)
        came.append(k)
        sums.append(total)
    return came, sums


def cursor_matches(lines: DataFrame, bags: DataFrame, keys: list[str], place: str, tokens: str, bag_place: str, bag_tokens: str, least_ahead: int = 10) -> DataFrame:
    """keys, place, bag and share: for each line, in order, the bag that holds the largest share of its distinct tokens, the
    first of equals, among the next ``max(least_ahead, a quarter of the key's bags)`` from the cursor on. The cursor follows
    a hit and stays after a miss (share 0, the bag at the cursor); ``bag`` is null where the key has none.

    The look-ahead is a share of the key's bags, so the bags from the cursor on are held, and no others.
    """
    left = lines.where(F.col(place).isNotNull()).select(F.col(place).alias("__place"), *keys, F.array_distinct(F.coalesce(F.col(tokens), F.array().cast("array<string>"))).alias("__tokens"))
    right = bags.where(F.col(bag_place).isNotNull()).select(F.col(bag_place).alias("__place"), *keys, F.col(bag_tokens).alias("__tokens"))
    first, then = (F.struct(F.lit(k).alias("side"), F.col("__place").cast("double").alias("at")) for k in (0, 1))

    def fold(events: Iterator[Event]) -> Iterator[Row]:
        held: deque[tuple[int, set[str]]] = deque()
        ahead = None
        for is_line, r in events:
            if not is_line:
                held.append((r["__place"], set(r["__tokens"] or ())))
                continue
            ahead = max(least_ahead, len(held) // 4) if ahead is None else ahead
            wanted, best, share = r["__tokens"], 0, 0.0
            for k in range(min(ahead, len(held))):
                got = sum(t in held[k][1] for t in wanted) / len(wanted) if wanted else 0.0
                if got > share:
                    best, share = k, got
            for _ in range(best):
                held.popleft()
            yield {k: r[k] for k in keys} | {"place": r["__place"], "bag": held[0][0] if held else None, "share": share}

    fields = T.StructType([*(f for f in lines.schema if f.name in keys), T.StructField("place", lines.schema[place].dataType), T.StructField("bag", bags.schema[bag_place].dataType), T.StructField("share", T.DoubleType())])
    return co_ordered(left, right, keys, then, first, fold, fields).withColumnRenamed("place", place)


def silence_shifts(gaps: DataFrame, silences: DataFrame, keys: list[str], gap_end: str, silence_end: str, most: float = 20.0) -> DataFrame:
    """keys, at and shift: for each gap, in order of its end, how far the silence is off whose end lies nearest to the gap's
    end moved by the shift found before (the earlier of equals); gaps without one less than ``most`` away are left out.

    A shift may lead anywhere, so the ends of a key's silences are held, as numbers.
    """
    left, right = (df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("__end"), *keys) for df, c in ((gaps, gap_end), (silences, silence_end)))
    first, then = (F.struct(F.lit(k).alias("side"), F.col("__end").alias("at")) for k in (0, 1))

    def fold(events: Iterator[Event]) -> Iterator[Row]:
        ends, shift = array("d"), 0.0
        for is_gap, r in events:
            if not is_gap:
                ends.append(r["__end"])
                continue
            aim = r["__end"] + shift
            k = bisect_left(ends, aim)
            near = min(((abs(ends[j] - aim), ends[j]) for j in (k - 1, k) if 0 <= j < len(ends)), default=None)
            if near is not None and near[0] < most:
                shift = near[1] - r["__end"]
                yield {c: r[c] for c in keys} | {"at": r["__end"], "shift": shift}

    fields = T.StructType([*(f for f in gaps.schema if f.name in keys), T.StructField("at", T.DoubleType()), T.StructField("shift", T.DoubleType())])
    return co_ordered(left, right, keys, then, first, fold, fields)


def shifted_starts(lines: DataFrame, shifts: DataFrame, keys: list[str], start: str, place: str) -> DataFrame:
    """lines with ``new_start``: the start moved by the last shift (see silence_shifts) at or before it, and never before that
    of the line before. Native: two windows over a key. Lines without a start have none."""
    own = lines.where(F.col(start).isNotNull())
    told = shifts.select(*keys, F.col("at").alias("__at"), F.col("shift").alias("__shift"), F.lit(0).alias("__side"))
    both = own.select(*keys, F.col(start).cast("double").alias("__at"), F.lit(1).alias("__side"), F.struct(*lines.columns).alias("__row"), F.col(place).alias("__place")).unionByName(told, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = both.withColumn("__to", F.col("__at") + F.coalesce(F.last("__shift", ignorenulls=True).over(w), F.lit(0.0))).where("__side = 1")
    out = moved.withColumn("new_start", F.max("__to").over(w)).select("__row.*", "new_start")
    return out.unionByName(lines.where(F.col(start).isNull()).withColumn("new_start", F.lit(None).cast("double")))
