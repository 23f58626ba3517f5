"""Sequential passes over the rows of a group: blocks, cursors, offsets that carry over, edited neighbours.

Each pass is a short fold over a group's rows in order; groups (songs, videos, users) run in parallel through ``in_order``,
and their rows stream by. A decision changes what later rows see; what a fold carries along for that is a few rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from itertools import tee

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .entity import Row, extended, in_order


def blocks_of(times: Iterable[tuple[float, float]], most_span: float, least_overlap: float, most_rows: int) -> Iterator[int | None]:
    """Block numbers of rows (start, end) in order of start: a row joins the open block if the block's starts stay within
    ``most_span``, it shares ``least_overlap`` with all of the block, and there is room. Rows without times have none."""
    first, low_end, last_start, n, block = 0.0, 0.0, 0.0, 0, -1
    for s, e in times:
        if s is None or e is None:
            yield None
            continue
        joins = n and n < most_rows and s - first <= most_span and min(low_end, e) - max(last_start, s) >= least_overlap
        if joins:
            low_end, last_start, n = min(low_end, e), max(last_start, s), n + 1
        else:
            block, first, low_end, last_start, n = block + 1, s, e, s, 1
        yield block


def block_numbers(starts: list[float], ends: list[float], most_span: float, least_overlap: float, most_rows: int) -> list[int]:
    """``blocks_of`` for lists."""
    return list(blocks_of(zip(starts, ends, strict=True), most_span, least_overlap, most_rows))


def visibility_blocks(df: DataFrame, keys: list[str], start: str, end: str, most_span: float = 1.4, least_overlap: float = 0.75, most_rows: int = 6) -> DataFrame:
    """df with ``block`` (blocks_of per key)."""

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        rows, ahead = tee(rows)
        for r, n in zip(rows, blocks_of(((r[start], r[end]) for r in ahead), most_span, least_overlap, most_rows), strict=True):
            yield r | {"block": n}

    return in_order(df, keys, [start, end], fold, extended(df, block=T.IntegerType()))


def shifts_by_silences(gaps: list[tuple[float, float]], silences: list[tuple[float, float]], most: float = 20.0) -> list[tuple[float, float]]:
    """(end of gap, offset so far) for each gap that finds a silence: probes are shifted by the offset found before, the
    silence whose end is nearest and less than ``most`` away counts."""
    out, offset = [], 0.0
    for _, end in gaps:
        near = min(((abs(z - end - offset), z) for _, z in silences), default=None)
        if near is not None and near[0] < most:
            offset = near[1] - end
            out.append((end, offset))
    return out


def shift_lines(starts: list[float], shifts: list[tuple[float, float]]) -> list[float]:
    """Starts moved by the last shift at or before them, kept in order."""
    out: list[float] = []
    for s in starts:
        moved = s + next((o for e, o in reversed(shifts) if e <= s), 0.0)
        out.append(max(moved, out[-1]) if out else moved)
    return out


def cursor_assignments(lines: list[set[str]], bags: list[set[str]], least_ahead: int = 10) -> list[tuple[int, float]]:
    """For each line the bag with the best share of its tokens among those from the cursor on, ``max(least_ahead, n / 4)``
    of them; the cursor follows a hit and stays after a miss."""
    out, cursor, ahead = [], 0, max(least_ahead, len(bags) // 4)
    for tokens in lines:
        shares = [(len(tokens & bags[k]) / len(tokens) if tokens else 0.0, -k) for k in range(cursor, min(len(bags), cursor + ahead))]
        share, place = max(shares, default=(0.0, -cursor))
        if share > 0:
            cursor = -place
        out.append((cursor if bags else -1, share))
    return out


def drop_weaker_repeats(df: DataFrame, keys: list[str], at: str, text: str, quality: str, ahead: int = 4, reach: float = 12.0, least_tokens: int = 3, least_ratio: float = 0.84, least_gap: float = 0.18) -> DataFrame:
    """Of two similar rows (among the next ``ahead``, within ``reach``) the clearly worse one goes; rows that went are
    compared no more."""

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        held: deque[list] = deque()  # [row, gone]

        def settle() -> Iterator[Row]:
            """Compares the oldest row with those held behind it and lets it go."""
            first = held[0]
            for other in list(held)[1 : 1 + ahead]:
                if first[1]:
                    break
                (a, b) = first[0], other[0]
                if other[1] or None in (a[at], b[at], a[text], b[text], a[quality], b[quality]) or b[at] - a[at] > reach or min(len(a[text].split()), len(b[text].split())) < least_tokens:
                    continue
                if abs(a[quality] - b[quality]) >= least_gap and SequenceMatcher(None, a[text], b[text]).ratio() >= least_ratio:
                    (first if a[quality] < b[quality] else other)[1] = True
            held.popleft()
            if not first[1]:
                yield first[0]

        for r in rows:
            held.append([r, False])
            if len(held) > ahead:
                yield from settle()
        while held:
            yield from settle()

    return in_order(df, keys, [at, text], fold, df.schema)


def trimmed(times: Iterable[tuple[float, float]], floor: float = 0.06) -> Iterator[tuple[float, float]]:
    """Rows (start, end) in order of start that never cross the next row's start; each keeps ``floor`` at least, and then
    pushes the next one on. Rows without times stay as they are."""
    reach = None
    now, ahead = tee(times)
    next(ahead, None)
    for s, e in now:
        following = next(ahead, None)
        if s is None or e is None:
            yield s, e
            continue
        s = s if reach is None else max(s, reach)
        e = e if following is None or following[0] is None else min(e, following[0])
        reach = max(e, s + floor)
        yield s, reach


def trim_overlaps(starts: list[float], ends: list[float], floor: float = 0.06) -> list[tuple[float, float]]:
    """``trimmed`` for lists."""
    return list(trimmed(zip(starts, ends, strict=True), floor))


def resolved_overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """df with new_start and new_end (trimmed per key)."""

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        rows, ahead = tee(rows)
        for r, (a, b) in zip(rows, trimmed((r[start], r[end]) for r in ahead), strict=True):
            yield r | {"new_start": a, "new_end": b}

    return in_order(df, keys, [start, end], fold, extended(df, new_start=T.DoubleType(), new_end=T.DoubleType()))
