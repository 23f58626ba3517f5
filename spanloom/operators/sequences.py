"""Order-dependent matching of two lists, where each choice depends on those before.

Every function works on one bounded group (the lines of a song, the turns of a conversation) given as arrays in a row,
or as the rows of a key; groups run in parallel.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import character_counts

PAIRS = T.ArrayType(T.StructType().add("i", T.IntegerType()).add("j", T.IntegerType()))
SCORED = T.ArrayType(T.StructType().add("i", T.IntegerType()).add("j", T.IntegerType()).add("score", T.DoubleType()))


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def may_reach(a: str, b: str, least: float) -> bool:
    """Whether the lengths of two texts allow a ratio of ``least``."""
    return 2 * min(len(a), len(b)) >= least * (len(a) + len(b))


def may_pair(left: list[str], right: list[str], least: float) -> np.ndarray:
    """For all pairs of two lists' texts whether their ratio may reach ``least``: matching characters are characters that
    both texts hold."""
    (a, n), (b, m) = character_counts(left), character_counts(right)
    out = np.zeros((len(left), len(right)), bool)
    for i in range(len(left)):
        shared = np.minimum(b, a[i]).sum(axis=1)
        out[i] = 2.0 * shared / np.maximum(n[i] + m, 1) >= least
    return out


def _list(x) -> list:
    return [] if x is None else list(x)


@F.pandas_udf(SCORED)
def greedy_pairs(left: pd.Series, right: pd.Series) -> pd.Series:
    """Each left text in turn takes the most similar right text not yet taken, if the ratio exceeds 0.5; the first of equals."""

    def one(a, b):
        free, out = dict(enumerate(_list(b))), []
        for i, x in enumerate(_list(a)):
            j, best = max(((j, ratio(x or "", y or "")) for j, y in free.items()), key=lambda p: p[1], default=(-1, 0.0))
            if best > 0.5:
                out.append({"i": i, "j": j, "score": best})
                del free[j]
        return out

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


@F.pandas_udf(PAIRS)
def token_matches(left: pd.Series, right: pd.Series) -> pd.Series:
    """One-to-one token matches: equal tokens first, then ratios of 0.86 or more among what is left."""

    def one(a, b):
        a, b = _list(a), _list(b)
        at: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            at.setdefault(y, []).append(j)
        out, free = [], set(range(len(b)))
        rest = []
        for i, x in enumerate(a):
            places = at.get(x)
            if places:
                out.append({"i": i, "j": (j := places.pop(0))})
                free.discard(j)
            else:
                rest.append(i)
        left = sorted(free)
        may = may_pair([a[i] for i in rest], [b[j] for j in left], 0.86)
        for i, row in zip(rest, may, strict=True):
            tries = (left[k] for k in np.flatnonzero(row).tolist())
            j, best = max(((j, ratio(a[i], b[j])) for j in tries if j in free and may_reach(a[i], b[j], 0.86)), key=lambda p: p[1], default=(-1, 0.0))
            if best >= 0.86:
                out.append({"i": i, "j": j})
                free.discard(j)
        return sorted(out, key=lambda p: p["i"])

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


@F.pandas_udf(PAIRS)
def equal_blocks(left: pd.Series, right: pd.Series) -> pd.Series:
    """Index pairs of the matching blocks of two token arrays."""

    def one(a, b):
        blocks = SequenceMatcher(None, _list(a), _list(b), autojunk=False).get_matching_blocks()
        return [{"i": m.a + k, "j": m.b + k} for m in blocks for k in range(m.size)]

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


@F.pandas_udf(PAIRS)
def two_pointer_lines(found: pd.Series, wanted: pd.Series) -> pd.Series:
    """Exact matches in order, moving on in ``found`` only: the first wanted line without a match ends all matching."""

    def one(a, b):
        out, at = [], 0
        a = _list(a)
        for j, y in enumerate(_list(b)):
            while at < len(a) and a[at] != y:
                at += 1
            if at == len(a):
                break
            out.append({"i": at, "j": j})
            at += 1
        return out

    return pd.Series([one(a, b) for a, b in zip(found, wanted, strict=True)])


def windowed_alignment(a: list[str], a_at: list[float], b: list[str], b_at: list[float], ahead: int = 12, least: float = 0.8) -> list[tuple[int, int]]:
    """Monotone pairs: from the current places, the best of the next ``ahead`` rows of either side by
    2 * similarity - 0.05 * rows skipped - 0.01 * min(seconds apart, 10); without one of ``least`` similarity, the side
    with the earlier clock moves on."""
    out, i, j = [], 0, 0
    may = may_pair(a, b, least)
    while i < len(a) and j < len(b):
        tries = [(i, j + k) for k in range(min(ahead, len(b) - j))] + [(i + k, j) for k in range(1, min(ahead, len(a) - i))]
        best, place = None, None
        for x, y in tries:
            s = 1.0 if a[x] == b[y] else ratio(a[x], b[y]) if may[x, y] and may_reach(a[x], b[y], least) else 0.0
            if s >= least:
                score = 2 * s - 0.05 * (x - i + y - j) - 0.01 * min(abs(a_at[x] - b_at[y]), 10.0)
                if best is None or score > best:
                    best, place = score, (x, y)
        if place is None:
            if a_at[i] <= b_at[j]:
                i += 1
            else:
                j += 1
        else:
            out.append(place)
            i, j = place[0] + 1, place[1] + 1
    return out


@F.pandas_udf(PAIRS)
def aligned_words(a: pd.Series, a_at: pd.Series, b: pd.Series, b_at: pd.Series) -> pd.Series:
    """windowed_alignment of two word arrays with their times."""
    return pd.Series([[{"i": i, "j": j} for i, j in windowed_alignment(*map(_list, row))] for row in zip(a, a_at, b, b_at, strict=True)])


@F.pandas_udf(T.DoubleType())
def soft_overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    """Greedy one-to-one matches of equal or very similar tokens (0.8) over the longer length; 0 if one is empty."""

    def one(a, b):
        a, b = _list(a), _list(b)
        n, longest, free = 0, max(len(a), len(b)), np.ones(len(b), bool)
        at: dict[str, list[int]] = {}
        for j in reversed(range(len(b))):
            at.setdefault(b[j], []).append(j)
        may = may_pair(a, b, 0.8)
        for x, row in zip(a, may, strict=True):
            while at.get(x) and not free[at[x][-1]]:  # taken by a similar token
                at[x].pop()
            hit = at[x][-1] if at.get(x) else next((j for j in np.flatnonzero(row & free).tolist() if may_reach(x, b[j], 0.8) and ratio(x, b[j]) >= 0.8), None)
            if hit is not None:
                free[hit] = False
                n += 1
        return n / longest if longest and n else 0.0

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType().add("token", T.StringType()).add("optional", T.BooleanType())))
def optional_tokens(text: pd.Series) -> pd.Series:
    """White-space tokens with a flag for those that stand within parentheses, which may nest; the signs themselves go."""

    def one(t):
        out, word, depth, flag = [], "", 0, False

        def flush():
            if word:
                out.append({"token": word, "optional": flag})

        for c in (t or "") + " ":
            if c in "()" or c.isspace():
                flush()
                word = ""
                depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
            else:
                flag = depth > 0 if not word else flag
                word += c
        return out

    return pd.Series([one(t) for t in text])


def capped_durations(durations: Column, total: Column, most: float) -> Column:
    """Durations cut to ``most`` each and to a running budget of ``total``; what is left of the budget goes to the last."""
    step = lambda a, d: F.struct((a["left"] - F.least(d, F.lit(most), a["left"])).alias("left"), F.concat(a["out"], F.array(F.least(d, F.lit(most), a["left"]))).alias("out"))
    start = F.struct(total.cast("double").alias("left"), F.array().cast("array<double>").alias("out"))
    end = F.aggregate(durations, start, step)
    n = F.size(end["out"])
    last = F.least(F.try_element_at(end["out"], F.lit(-1)) + end["left"], F.lit(most))
    return F.when(n > 0, F.concat(F.slice(end["out"], F.lit(1), n - 1), F.array(last))).otherwise(end["out"])


def retimed(words: Column, line_start: Column, factor: Column) -> Column:
    """Word structs (start, end, ...) with times scaled about the line's start."""
    return F.transform(words, lambda w: w.withField("start", line_start + (w["start"] - line_start) * factor).withField("end", line_start + (w["end"] - line_start) * factor))


def reflowed(words: Column, low: Column, high: Column) -> Column:
    """Word structs dealt over the window (0.2 long at least) in equal slots; a word lasts 0.9 of its slot."""
    slot = F.greatest(high - low, F.lit(0.2)) / F.size(words)
    return F.transform(words, lambda w, k: w.withField("start", low + k * slot).withField("end", low + k * slot + 0.9 * slot))
