"""Scores, bands and policies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(score: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that the score reaches; cuts fall. Null gives null."""
    out = F.when(score.isNull(), None)
    for cut, name in cuts:
        out = out.when(score >= cut, name)
    return out.otherwise(rest)


#: Bands of a quality score.
QUALITY = [(0.8, "excellent"), (0.65, "good"), (0.5, "fair")]


def weighted_score(terms: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the terms that are not null; null if all are."""
    weight = sum((F.when(t.isNotNull(), w).otherwise(0.0) for t, w in terms), F.lit(0.0))
    total = sum((F.coalesce(t * w, F.lit(0.0)) for t, w in terms), F.lit(0.0))
    return total / F.when(weight > 0, weight)


def inverse_score(terms: list[tuple[Column, float]]) -> Column:
    """Sum of weight / (1 + term); null terms are skipped."""
    return sum((F.coalesce(w / (1 + t), F.lit(0.0)) for t, w in terms), F.lit(0.0))


def duration_bonus(gap: Column) -> Column:
    """10 within 10 seconds, 5 within 20, else 0; 0 for an unknown gap."""
    return F.when(F.abs(gap) <= 10, 10).when(F.abs(gap) <= 20, 5).otherwise(0)


def offset_policy(delta: Column, dead: float = 0.3, most: float = 2.5, scale: float = 1.0) -> Column:
    """0 inside the dead band, delta * scale up to ``most``, and 0 for suspicious ones beyond."""
    return F.when(F.abs(delta) <= dead, 0.0).when(F.abs(delta) <= most, delta * scale).otherwise(0.0)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The label of the first rule that holds; null if none does."""
    out = F.when(F.lit(False), None)
    for condition, label in rules:
        out = out.when(condition, label)
    return out


def estimated_duration(last: Column, span: Column) -> Column:
    """Last start plus a tenth of the span, 3 to 6 seconds of it."""
    return last + clamp(F.floor(span * 0.1), 3, 6)
