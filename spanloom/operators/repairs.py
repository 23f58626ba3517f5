"""Merges and repairs of recognised rows: like texts in one lane that overlap, come again, fade in or stand out of order.

Each pass is a fold over the rows of one group (a video, a song) in order of time, because a merge changes what later rows
meet; groups run in parallel, and rows stream by in stretches that no merge crosses (``passes``). Rows without times never
merge; a null text is like no other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entity import Row, extended, in_order, unbroken
from .sequences import ratio


@dataclass
class Entry:
    """A row on screen from first to last; ``row`` is its place in the group."""

    text: str
    first: float
    last: float
    y: float
    row: int = 0
    brightness: float = 255.0
    inferred: bool = False

    @property
    def length(self) -> float:
        return self.last - self.first

    @property
    def tokens(self) -> list[str]:
        return self.text.lower().split()


Pass = Callable[[list[Entry]], list[Entry]]


_ratio = lru_cache(1 << 16)(ratio)


def like(a: Entry, b: Entry) -> float:
    return _ratio(a.text.lower(), b.text.lower())


def extend(into: Entry, other: Entry) -> None:
    into.first, into.last = min(into.first, other.first), max(into.last, other.last)


def merge_overlaps(entries: list[Entry], lane: float, look_back: int = 10, least: float = 0.95, shared: float = 0.35) -> list[Entry]:
    """A row that overlaps one of the last rows kept, in its lane and with its text, extends that one."""
    out: list[Entry] = []
    for e in entries:
        hits = (p for p in reversed(out[-look_back:]) if abs(p.y - e.y) <= lane and min(p.last, e.last) - max(p.first, e.first) >= shared and like(p, e) >= least)
        found = next(hits, None)
        if found is None:
            out.append(e)
        else:
            extend(found, e)
    return out


def merge_reentries(entries: list[Entry], lane: float, look_back: int = 12, least: float = 0.9, gap: float = 1.5, long_gap: float = 4.0, short: float = 1.6) -> list[Entry]:
    """A row that comes again in its lane within ``gap`` extends the earlier one, unless another text stood there
    meanwhile; one or two words that last ``short`` at most may come again within ``long_gap``, after a row of a second or
    more or while another lane shows the text."""
    out: list[Entry] = []
    for e in entries:
        at = next((k for k in range(len(out) - 1, max(-1, len(out) - 1 - look_back), -1) if abs(out[k].y - e.y) <= lane and like(out[k], e) >= least), None)
        if at is not None and 0 <= e.first - out[at].last <= long_gap:
            before, between = out[at], out[at + 1 :]
            taken = any(abs(m.y - e.y) <= lane and like(m, e) < least for m in between)
            elsewhere = any(abs(m.y - e.y) > lane and like(m, e) >= least for m in between)
            few = len(e.tokens) <= 2 and len(before.tokens) <= 2 and e.length <= short and (before.length >= 1.0 or elsewhere)
            if not taken and (e.first - before.last <= gap or few):
                before.last = max(before.last, e.last)
                continue
        out.append(e)
    return out


def one_line(a: Entry, b: Entry, least: float = 0.72, share: float = 0.75) -> bool:
    """Like texts, or the tokens of one within the other."""
    if like(a, b) >= least:
        return True
    short, long = sorted((a.tokens, b.tokens), key=len)
    if not short or len({*short} & {*long}) < share * min(len({*short}), len({*long})):
        return False
    return " ".join(short) in " ".join(long)


def touching(a: Entry, b: Entry, near: float = 0.2) -> float:
    """Seconds that two rows share; 0.1 if one begins about when the other ends."""
    shared = min(a.last, b.last) - max(a.first, b.first)
    return shared if shared > 0 else 0.1 if abs(b.first - a.last) < near or abs(a.first - b.last) < near else 0.0


def fades(a: Entry, b: Entry, shared: float) -> bool:
    """Whether one row looks like the dim beginning or end of the other."""
    if a.length > 2 * b.length and a.brightness > 1.2 * b.brightness:
        return True
    low, high = sorted((a.length, b.length))
    return shared > 0.5 * max(0.01, low) and (low < 1.5 and high > 3.0 or abs(a.brightness - b.brightness) > 40)


def merge_fades(entries: list[Entry], lane: float) -> list[Entry]:
    """Of two rows of a lane of which one fades into the other, the dimmer or shorter one goes; rows gone are met no more.

    Each row in turn meets the others in order. Those that can't fade into it, by time, lane, length and brightness, are
    left out by arrays first, so texts are compared only where the rest fits.
    """
    left = dict(enumerate(entries))
    first, last, y, light = (np.array([getattr(e, n) for e in entries], float) for n in ("first", "last", "y", "brightness"))
    there = np.ones(len(entries), bool)

    def may_fade(i: int, met: int) -> list[int]:
        """Rows after ``met`` that row i may fade into, or they into it."""
        length, own = last - first, last[i] - first[i]
        low, high, apart = np.minimum(length, own), np.maximum(length, own), np.abs(light - light[i])
        near = there & (np.abs(y - y[i]) <= lane) & (first <= last[i] + 0.25) & (last >= first[i] - 0.25)
        near &= (own > 2 * length) & (light[i] > 1.2 * light) | (low < 1.5) & (high > 3.0) | (apart > 40)
        near[: met + 1] = near[i] = False
        return np.flatnonzero(near).tolist()

    for i in range(len(entries)):
        met, todo = -1, deque(may_fade(i, -1)) if i in left else deque()
        while todo and i in left:
            met = j = todo.popleft()
            a, b = left[i], left[j]
            if abs(a.y - b.y) <= lane and (shared := touching(a, b)) > 0 and fades(a, b, shared) and one_line(a, b):
                win, lose = (i, j) if a.brightness > b.brightness + 20 or a.length > b.length + 1 else (j, i)
                extend(left[win], left.pop(lose))
                first[win], last[win], there[lose] = left[win].first, left[win].last, False
                if win == i:
                    todo = deque(may_fade(i, met))
    return list(left.values())


def add_cycles(entries: list[Entry], lane: float, least: float = 0.97, long: float = 6.0, shared: float = 7.0, gaps: tuple[float, float] = (4.0, 10.5)) -> list[Entry]:
    """Two long rows of one text in different lanes, a steady gap apart: the next turn of that cycle is inferred once.

    Rows are taken in order of their beginning, each with those that begin at most the longest gap after it; whether a turn
    is there already is looked up by time.
    """
    out = list(entries)
    by_time = sorted((e.first, k) for k, e in enumerate(out))
    long_ones = sorted((e for e in entries if e.length >= long), key=lambda e: e.first)
    for k, a in enumerate(long_ones):
        for b in islice(long_ones, k + 1, None):
            gap, end, begun = b.first - a.first, min(a.last, b.last), b.first
            if gap > gaps[1]:
                break
            at = begun + gap
            steady = gap >= gaps[0] and end - begun >= max(shared, gap - 0.5) and begun + 2 < at < end - 1
            if not steady or abs(a.y - b.y) <= lane or like(a, b) < least:
                continue
            near = (out[x] for _, x in by_time[bisect_left(by_time, (at - 1.25,)) : bisect_right(by_time, (at + 1.25, len(out)))])
            if not any(abs(x.y - b.y) <= lane and abs(x.first - at) <= 1.2 and like(x, b) >= least for x in near):
                out.append(replace(b, first=at, last=min(b.last, at + 1.2), inferred=True))
                insort(by_time, (at, len(out) - 1))
    return sorted(out, key=lambda e: (e.first, e.y))


def passes(df: DataFrame, keys: list[str], steps: list[Pass], text: str = "text", first: str = "first", last: str = "last", y: str = "y", brightness: str | None = None, reach: float = 4.0) -> DataFrame:
    """df after the steps, with edited ``first`` and ``last`` and ``inferred`` for rows that a step added.

    Steps see stretches of rows: where one begins more than ``reach`` seconds after all before it have ended, a new one
    begins. No step here joins rows over such a gap (the longest that counts is merge_reentries' long_gap).
    """

    def stretch(rows: list[Row]) -> Iterator[Row]:
        if rows[0][first] is None or rows[0][last] is None:
            yield rows[0] | {"inferred": False}
            return
        entries = [Entry(r[text] or "", float(r[first]), float(r[last]), float(r[y]), k, float(r[brightness]) if brightness else 255.0) for k, r in enumerate(rows)]
        for step in steps:
            entries = step(entries)
        for e in entries:
            yield rows[e.row] | {first: e.first, last: e.last, "inferred": e.inferred}

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        for held in unbroken(rows, first, last, reach):
            yield from stretch(held)

    return in_order(df, keys, [first, y, text], fold, extended(df, inferred=T.BooleanType()))


Line = tuple[float | None, str, float, float]


def swapped(a: Line, b: Line) -> bool:
    """Whether two neighbours (start, text, quality, sure) change places: more than 0.75 s out of order, with like texts
    (0.82), or short ones of which one is unsure, and of clearly different quality unless nearly equal."""
    x, y = a[1].lower().split(), b[1].lower().split()
    if not x or not y or a[0] is None or b[0] is None or not a[0] > b[0] + 0.75:
        return False
    r = ratio(" ".join(x), " ".join(y))
    short = len(x) <= 3 and len(y) <= 4 and min(a[3], b[3]) < 0.45
    return (r >= 0.82 or short) and (r >= 0.9 or abs(a[2] - b[2]) >= 0.05)


def one_pass(rows: Iterable, line: Callable) -> Iterator:
    """Rows with neighbours swapped, going once from front to back: all that is carried along is one row."""
    rows = iter(rows)
    held = next(rows, None)
    if held is None:
        return
    for r in rows:
        if swapped(line(held), line(r)):
            yield r
        else:
            yield held
            held = r
    yield held


def repaired(rows: Iterable, line: Callable, most_passes: int = 4) -> Iterator:
    """Rows after ``most_passes`` passes, each fed by the one before; a pass without swaps changes nothing."""
    for _ in range(most_passes):
        rows = one_pass(rows, line)
    yield from rows


def repaired_order(starts: list[float], texts: list[str], quality: list[float], sure: list[float], most_passes: int = 4) -> list[int]:
    """``repaired`` for lists: the places of the rows in their new order."""
    lines = list(zip(starts, texts, quality, sure, strict=True))
    return list(repaired(range(len(lines)), lines.__getitem__, most_passes))


def repair_inversions(df: DataFrame, keys: list[str], place: str, start: str, text: str, quality: str, sure: str) -> DataFrame:
    """df with ``new_place`` from 0 (``repaired`` of the rows in order of ``place``, then start)."""

    def line(r: Row) -> Line:
        return r[start], r[text] or "", r[quality] or 0.0, r[sure] or 0.0

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        for k, r in enumerate(repaired(rows, line)):
            yield r | {"new_place": k}

    return in_order(df, keys, [place, start], fold, extended(df, new_place=T.IntegerType()))


@F.arrow_udf(T.IntegerType())
def last_match(found: pa.Array, wanted: pa.Array) -> pa.Array:
    """Place (from 0) of the last found text that is like any wanted one (0.45); null if none is. What follows it can go."""

    def one(a, b):
        a, b = ([] if x is None else [(t or "").lower() for t in x] for x in (a, b))
        return next((k for k in range(len(a) - 1, -1, -1) if any(ratio(a[k], y) >= 0.45 for y in b)), None)

    # few rows at a time are Python lists, the others stay in Arrow
    places: list[int | None] = []
    for at in range(0, len(found), 256):
        places += map(one, found.slice(at, 256).to_pylist(), wanted.slice(at, 256).to_pylist())
    return pa.array(places, pa.int32())
