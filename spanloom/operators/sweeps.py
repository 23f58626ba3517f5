"""Sweeps over rows on screen: a line moves along a key's rows in order of time, with the set of rows that are open under it.

A row opens when the line meets it and closes when the line has passed all that its rule looks at; what is held is what is
open, a state of fixed size each (for pairs: the rows of their common time). Rows that a rule infers are then held against
those that are there, by text and time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entity import Row, extended, in_order
from .sequences import ratio


@lru_cache(1 << 16)
def alike(a: str, b: str) -> float:
    return ratio(a, b)


@dataclass
class Epochs:
    """A long row and what its companions, who come one after the other, say about it."""

    row: Row
    heads: set[str] = field(default_factory=set)
    companions: int = 0
    family: str | None = None
    at: float = 0.0
    starts: list[float] = field(default_factory=list)

    def meet(self, r: Row, rule: EpochRule) -> None:
        a = self.row
        if abs(r["y"] - a["y"]) <= rule.lane or r["first"] < a["first"] - rule.slack or r["first"] > a["last"] + rule.slack or alike(r["text"], a["text"]) >= rule.unlike:
            return
        words = r["text"].split()
        self.companions += 1
        if words and len(self.heads) < 2:
            self.heads.add(words[0])
        t, family = r["first"], " ".join(words[:3])
        if not a["first"] + rule.after < t < a["last"] - rule.before or not family or len(self.starts) == rule.most:
            return
        changed = self.family is not None and family != self.family and t - self.at >= rule.settled
        if changed and not (self.starts and t - self.starts[-1] < rule.apart):
            self.starts.append(t)
        self.family, self.at = family, t

    @property
    def found(self) -> list[float]:
        return self.starts if self.companions >= 2 and len(self.heads) >= 2 else []


@dataclass(frozen=True)
class EpochRule:
    """Seconds, and units of y. A row of ``words`` words or more that lasts ``long`` has companions: rows of other texts
    (less alike than ``unlike``), more than ``lane`` away, that begin with ``slack`` while it lasts. Where these change from
    one family (their first three words) to another that has not shown for ``settled``, from ``after`` its beginning to
    ``before`` its end, it is taken to begin anew: ``most`` times, ``apart`` from each other."""

    words: int = 4
    long: float = 5.5
    lane: float = 16.0
    unlike: float = 0.85
    slack: float = 0.2
    after: float = 2.0
    before: float = 0.8
    settled: float = 1.1
    apart: float = 2.2
    most: int = 2


def epochs(rows: DataFrame, keys: list[str], near: float, few: int = 4, rule: EpochRule = EpochRule(), lasting: float = 1.2) -> DataFrame:  # noqa: B008
    """Inferred rows: keys, of (the row that begins anew), text, first, last and y, without those that are there already.

    ``rows``: keys, id, text (normalised), first, last, y and short (rows that no epochs are sought for). A text that ``few``
    rows or more of its lane (``near``) have is left as it is. Rows without text, times or y count for nothing.
    """
    known = rows.where("text IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL AND y IS NOT NULL")
    by = ", ".join(f"`{k}`" for k in [*keys, "text"])
    same = F.expr(f"count(*) OVER (PARTITION BY {by} ORDER BY cast(y AS double) RANGE BETWEEN {float(near)}D PRECEDING AND {float(near)}D FOLLOWING)")
    counted = known.select(*keys, "id", "text", *(F.col(c).cast("double").alias(c) for c in ("first", "last", "y")), F.coalesce("short", F.lit(False)).alias("short"), same.alias("same"))

    def fold(group: Iterator[Row]) -> Iterator[Row]:
        open_: list[Epochs] = []
        recent: list[Row] = []

        def closed(at: float) -> Iterator[Row]:
            nonlocal open_
            for e in open_:
                if e.row["last"] + rule.slack < at:
                    yield from ({k: e.row[k] for k in keys} | {"of": e.row["id"], "of_first": e.row["first"], "text": e.row["text"], "first": t, "last": min(e.row["last"], t + lasting), "y": e.row["y"]} for t in e.found)
            open_ = [e for e in open_ if e.row["last"] + rule.slack >= at]

        for r in group:
            yield from closed(r["first"])
            for e in open_:
                e.meet(r, rule)
            recent = [x for x in recent if x["first"] >= r["first"] - rule.slack]
            if len(r["text"].split()) >= rule.words and not r["short"] and r["last"] - r["first"] >= rule.long and r["same"] < few:
                e = Epochs(r)
                for x in recent:
                    e.meet(x, rule)
                open_.append(e)
            recent.append(r)
        yield from closed(float("inf"))

    return not_there(in_order(counted, keys, ["first", "y", "id"], fold, _inferred(counted, keys)), counted, keys, near)


def _inferred(rows: DataFrame, keys: list[str]) -> T.StructType:
    number = [T.StructField(n, T.DoubleType()) for n in ("of_first", "first", "last", "y")]
    return T.StructType([*(f for f in rows.schema if f.name in keys), T.StructField("of", rows.schema["id"].dataType), T.StructField("text", T.StringType()), *number])


def not_there(inferred: DataFrame, rows: DataFrame, keys: list[str], near: float, within: float = 1.2) -> DataFrame:
    """Inferred rows without those that begin within ``within`` of a row of their text and lane (``near``): one that is there,
    or one inferred before it (in order of the rows they come from)."""
    cell = F.floor(F.col("first") / within)
    there = rows.select(*keys, "text", F.col("first").alias("__first"), F.col("y").alias("__y"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    same = [*keys, "text", "__cell"]
    a, b = inferred.withColumn("__cell", cell).alias("a"), there.alias("b")
    met = (F.abs(F.col("a.first") - F.col("b.__first")) <= within) & (F.abs(F.col("a.y") - F.col("b.__y")) <= near)
    for c in same:
        met = met & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    left = a.join(b, met, "left_anti").drop("__cell")

    def fold(group: Iterator[Row]) -> Iterator[Row]:
        given: list[tuple[float, float]] = []
        for r in group:
            if not any(abs(r["first"] - t) <= within and abs(r["y"] - y) <= near for t, y in given):
                given.append((r["first"], r["y"]))
                yield r
            given = [g for g in given if g[0] >= r["of_first"] - within]  # what comes later begins after its own row does

    return in_order(left, [*keys, "text"], ["of_first", "of", "first"], fold, left.schema).drop("of_first")


@dataclass
class Pair:
    """Two rows of one text in different lanes, and what begins while both are there."""

    anchor: Row
    other: Row
    start: float
    end: float
    refrains: list[Row] = field(default_factory=list)
    companions: list[float] = field(default_factory=list)

    def meet(self, r: Row, unlike: float) -> None:
        if self.start <= r["first"] <= self.end:
            if r["short"]:
                self.refrains.append(r)
            elif alike(r["text"], self.anchor["text"]) < unlike:
                self.companions.append(r["first"])

    def found(self, most: int, inside: float = 10.0, after: float = 2.2, apart: float = 3.0, long: float = 6.0, step: float = 4.0, rest: float = 1.4, clear: float = 1.6) -> list[float]:
        """When the anchor's text is taken to begin anew: with the refrains between both lanes (or all, if fewer than two lie
        there), ``apart`` from each other; with one long refrain every ``step``; and with companions that come after a rest
        and not at such a time. From ``after`` the other row's beginning on."""
        if len(self.refrains) < 3:
            return []
        low, high = sorted((self.anchor["y"], self.other["y"]))
        between = [r for r in self.refrains if low + inside <= r["y"] <= high - inside]
        refrains = between if len(between) >= 2 else self.refrains
        earliest, starts = self.other["first"] + after, []
        for r in refrains:
            if r["first"] > earliest and not (starts and r["first"] - starts[-1] < apart):
                starts.append(r["first"])
        if len(starts) < 2:
            longest = max(refrains, key=lambda r: r["last"] - r["first"])
            if longest["last"] - longest["first"] >= long:
                t = max(earliest, longest["first"] + after)
                while t <= min(self.end - 1.0, longest["last"] - 1.0):
                    if not starts or t - starts[-1] >= apart:
                        starts.append(t)
                    t += step
        before = None
        for t in self.companions:
            if t > earliest:
                if (before is None or t - before >= rest) and not any(abs(t - s) < clear for s in starts):
                    starts.append(t)
                before = t
        return sorted(starts)[:most]


def repetitions(rows: DataFrame, keys: list[str], near: float, shared: float = 3.0, long: float = 8.0, later: float = 4.0, unlike: float = 0.9, most: int = 6, lasting: float = 1.2) -> DataFrame:
    """Inferred rows (as in epochs) of rows that stand in two lanes at once for so long that their text must come again.

    Two rows of one text, neither ``short``, more than ``near`` apart in y, that share ``shared`` seconds or more; one lasts
    ``long``, and the shorter one (the later one of equals) begins ``later`` after the other. See Pair.found.
    """
    known = rows.where("text IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL AND y IS NOT NULL")
    known = known.select(*keys, "id", "text", *(F.col(c).cast("double").alias(c) for c in ("first", "last", "y")), F.coalesce("short", F.lit(False)).alias("short"))

    def fold(group: Iterator[Row]) -> Iterator[Row]:
        open_: list[Row] = []
        pairs: list[Pair] = []
        together: list[Row] = []  # rows that begin at the line

        def closed(at: float) -> Iterator[Row]:
            nonlocal pairs
            for p in pairs:
                if p.end < at:
                    yield from ({k: p.anchor[k] for k in keys} | {"of": p.anchor["id"], "of_first": p.anchor["first"], "text": p.anchor["text"], "first": t, "last": min(p.anchor["last"], t + lasting), "y": p.anchor["y"]} for t in p.found(most))
            pairs = [p for p in pairs if p.end >= at]

        for r in group:
            yield from closed(r["first"])
            for p in pairs:
                p.meet(r, unlike)
            together = [x for x in together if x["first"] == r["first"]] + [r]
            open_ = [x for x in open_ if x["last"] - r["first"] >= shared]
            if r["short"]:
                continue
            for x in open_:
                end, lengths = min(x["last"], r["last"]), (x["last"] - x["first"], r["last"] - r["first"])
                if x["text"] == r["text"] and abs(x["y"] - r["y"]) > near and end - r["first"] >= shared and max(lengths) >= long:
                    anchor, other = (x, r) if lengths[0] >= lengths[1] else (r, x)
                    if other["first"] - anchor["first"] >= later:
                        pairs.append(Pair(anchor, other, r["first"], end))
                        for y in together:
                            pairs[-1].meet(y, unlike)
            if r["last"] - r["first"] >= shared:
                open_.append(r)
        yield from closed(float("inf"))

    return not_there(in_order(known, keys, ["first", "y", "id"], fold, _inferred(known, keys)), known, keys, near)


def screen_blocks(rows: DataFrame, keys: list[str], start: str, end: str, y: str, row_id: str, most_span: float = 1.4, least_overlap: float = 0.75, most_rows: int = 6, short: float = 0.8, short_span: float = 1.8, short_overlap: float = 0.15) -> DataFrame:
    """rows with ``block`` and ``row``: rows that appear together, numbered by their beginning, and their place from top to
    bottom; null for rows that stand alone, or end before they start.

    In order of start, end, y and id a row joins the open block if all starts stay within ``most_span``, it and the block's
    whole time share ``least_overlap``, and the block has fewer than ``most_rows``; a row of ``short`` seconds or less may
    be ``short_span`` apart and share ``short_overlap`` only. One block is held.
    """

    def fold(group: Iterator[Row]) -> Iterator[Row]:
        held: list[Row] = []
        low = high = 0.0  # the block's last end, and the latest start
        number = 0

        def closed() -> Iterator[Row]:
            nonlocal number
            if len(held) < 2:
                yield from (r | {"block": None, "row": None} for r in held)
                return
            places = {id(r): k for k, r in enumerate(sorted(held, key=lambda r: (r[y] or 0.0, r[start], r[row_id])))}
            yield from (r | {"block": number, "row": places[id(r)]} for r in held)
            number += 1

        for r in group:
            s, e = r[start], r[end]
            if s is None or e is None or e <= s:
                yield r | {"block": None, "row": None}
                continue
            brief = e - s <= short
            span, overlap = (max(most_span, short_span), min(least_overlap, short_overlap)) if brief else (most_span, least_overlap)
            if held and (max(high, s) - held[0][start] > span or min(low, e) - max(held[0][start], s) < overlap or len(held) >= most_rows):
                yield from closed()
                held = []
            low, high = (max(low, e), max(high, s)) if held else (e, s)
            held.append(r)
        yield from closed()

    return in_order(rows, keys, [start, end, y, row_id], fold, extended(rows, block=T.IntegerType(), row=T.IntegerType()))


def is_repeat(like: float, apart: float, later: float, gap: float, near: float = 5.0) -> bool:
    """Whether a row repeats an earlier one, by how alike their texts are, how far apart they stand, how much later it
    begins, and how long after the other's end. Rows that begin ``near`` each other may be read badly; a later one must
    begin ``near`` the end of the other and say nearly the same."""
    if later < near:
        return like > 0.7 and apart < 30 or 0.6 <= like <= 0.7 and apart < 40
    return gap < near and like > 0.85 and apart < 30


def reads_better(new: Row, old: Row, clearly: float = 1.0) -> bool:
    """Whether a row's text stands for both: the one that lasts clearly longer, else that of more words, else of more letters."""
    longer = (new["last"] - new["first"]) - (old["last"] - old["first"])
    letters = lambda r: sum(c.isalpha() for c in r["text"])
    return longer > clearly or longer >= -clearly and (len(new["text"].split()), letters(new)) > (len(old["text"].split()), letters(old))


def merged_repeats(rows: DataFrame, keys: list[str], near: float = 5.0, guard: bool = True, tail: float = 0.8) -> DataFrame:
    """keys, id, text, first, last, y, visible and rows: of rows that repeat each other one is left, which spans them all.

    ``rows``: keys, id, text, first, last, y and visible. In order of first, y and id a row goes into the first one left
    that it repeats (is_repeat), whose place and id stay; of both texts the one that reads better is left. With ``guard``,
    a row that was never visible doesn't go into a visible one of its lane that ended ``tail`` or more before: it is what a
    dim screen left. Rows without text, times or y stay. A row that ended and began ``near`` or more before is repeated by
    none that come, so it goes out: what is held is what stands on screen, and a little before.
    """
    kind = T.StructType([*(f for f in rows.schema if f.name in keys), rows.schema["id"], T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("first", "last", "y")), T.StructField("visible", T.BooleanType()), T.StructField("rows", T.LongType())])
    plain = rows.select(*keys, "id", "text", *(F.col(c).cast("double").alias(c) for c in ("first", "last", "y")), F.coalesce("visible", F.lit(False)).alias("visible"), F.lit(1).cast("long").alias("rows"))

    def fold(group: Iterator[Row]) -> Iterator[Row]:
        held: list[Row] = []
        for r in group:
            if None in (r["text"], r["first"], r["last"], r["y"]):
                yield r
                continue
            yield from (u for u in held if r["first"] - u["first"] >= near and r["first"] - u["last"] >= near)
            held = [u for u in held if r["first"] - u["first"] < near or r["first"] - u["last"] < near]
            for u in held:
                like, apart = alike(r["text"], u["text"]), abs(r["y"] - u["y"])
                if guard and u["visible"] and not r["visible"] and like > 0.8 and apart < 30 and r["first"] >= u["last"] + tail:
                    continue
                if is_repeat(like, apart, r["first"] - u["first"], max(0.0, r["first"] - u["last"]), near):
                    if reads_better(r, u):
                        u["text"] = r["text"]
                    u["last"], u["rows"] = max(u["last"], r["last"]), u["rows"] + 1
                    break
            else:
                held.append(r)
        yield from held

    return in_order(plain, keys, ["first", "y", "id"], fold, kind)
