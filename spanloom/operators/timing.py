"""Scores of timed lines against what was heard, and states of rows over time. One sort a key; nothing is paired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of, nearest

#: Fixed values, in seconds: a start is matched within MATCHED of an onset, and an issue from ISSUE on.
MATCHED, ISSUE, MODERATE, SEVERE = 0.5, 0.3, 0.5, 1.0


def start_issues(lines: DataFrame, onsets: DataFrame, keys: list[str], start: str) -> DataFrame:
    """lines with delta (the nearest onset less the start; null without onsets), issue (early_line, late_line or null) and
    severity (minor, moderate, severe). onsets: keys, start."""
    told = onsets.select(*keys, start).withColumn("__onset", F.lit(0))
    found = nearest(lines, told, keys, start, "__onset").withColumn("delta", F.col("__onset_at") - F.col(start)).drop("__onset", "__onset_at")
    off = F.abs("delta")
    issue = F.when(off > ISSUE, F.when(F.col("delta") > 0, "early_line").otherwise("late_line"))
    return found.withColumns({"issue": issue, "severity": F.when(off > ISSUE, F.when(off < MODERATE, "minor").when(off < SEVERE, "moderate").otherwise("severe"))})


def start_score(issues: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_lines, n_matched, n_issues and score: the percentage of lines that start within MATCHED of an onset."""
    out = issues.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(F.abs("delta") <= MATCHED).alias("n_matched"), F.count("issue").alias("n_issues"))
    return out.withColumn("score", 100.0 * F.col("n_matched") / F.col("n_lines"))


def pause_score(lines: DataFrame, silences: DataFrame, keys: list[str], start: str, end: str, order: str, vocal_start: Column, least: float = 2.0, slack: float = 0.5) -> DataFrame:
    """keys, n_silences, n_matched and score: the percentage of long silences that some pair of lines one after the other
    leaves free; 100 for keys (of lines or silences) without long silences. Silences (keys, start, end, and what vocal_start needs) count when they begin after the vocals do, and
    are matched also when they begin together.

    A pair leaves a silence free if its first line ends by the silence's start and its second starts at the silence's end
    or later, both with slack: so the latest next start among pairs that end in time decides, a running maximum.
    """
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(order))
    pairs = lines.withColumn("__next", following).where("__next IS NOT NULL").select(*keys, F.col(end).alias("__at"), F.col("__next"), F.lit(None).cast("double").alias("__end"), F.lit(None).cast("boolean").alias("__in"))
    long = silences.where((F.col(end) - F.col(start) >= least) & (F.col(start) >= vocal_start))
    asked = long.select(*keys, (F.col(start) + slack).alias("__at"), F.lit(None).cast("double").alias("__next"), F.col(end).cast("double").alias("__end"), (F.col(start) > vocal_start).alias("__in"))
    w = Window.partitionBy(*keys).orderBy("__at", F.col("__end").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = pairs.unionByName(asked).withColumn("__latest", F.max("__next").over(w)).where("__end IS NOT NULL")
    out = seen.groupBy(*keys).agg(F.count_if("__in").alias("n_silences"), F.count_if(F.coalesce(F.col("__latest") >= F.col("__end") - slack, F.lit(False))).alias("n_matched"))
    every = lines.select(*keys).union(silences.select(*keys)).distinct()
    none = lambda c: F.when(F.col("n_silences") > 0, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    score = F.when(F.col("n_silences") > 0, 100.0 * F.col("n_matched") / F.col("n_silences")).otherwise(100.0)
    return every.join(out, keys, "left").select(*keys, none("n_silences"), none("n_matched"), score.alias("score"))


def assignment_profile(assigned: DataFrame, keys: list[str], token: Column, known: Column, placeholder: Column, drift: Column, segment: Column) -> DataFrame:
    """For each line (keys) of assigned words: n_assigned, overlap (share of the words whose token the line knows),
    placeholders (share), median_drift and max_drift (of absolute values), n_segments."""
    rows = assigned.select(*keys, ((token != "") & known).alias("__known"), placeholder.alias("__placeholder"), F.abs(drift).alias("__drift"), segment.alias("__segment"))
    share = lambda c: F.count_if(c) / F.count("*")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_assigned"), share("__known").alias("overlap"), share("__placeholder").alias("placeholders"), F.median("__drift").alias("median_drift"), F.max("__drift").alias("max_drift"), F.count_distinct("__segment").alias("n_segments"),
    )


def onset_bias(lines: DataFrame, onsets: DataFrame, keys: list[str], start: str, window: float, kind: Column) -> DataFrame:
    """How far the first onset at or after each start (within ``window``) lies behind it: by keys, n, mean, p95 (the value
    at the floor of 95 % of the way) and the means of lines with and without ``kind``."""
    told = onsets.select(*keys, start).withColumn("__onset", F.lit(0))
    found = as_of(lines.withColumn("__kind", kind), told, keys, start, "__onset", "forward", window).where("__onset_at IS NOT NULL").withColumn("__delta", F.col("__onset_at") - F.col(start))
    w = Window.partitionBy(*keys)
    placed = found.withColumns({"__n": F.count("*").over(w), "__rank": F.row_number().over(w.orderBy("__delta"))})
    return placed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("__delta").alias("mean"), F.max(F.when(F.col("__rank") == F.floor(0.95 * (F.col("__n") - 1)) + 1, F.col("__delta"))).alias("p95"),
        F.avg(F.when(F.col("__kind"), F.col("__delta"))).alias("mean_of_kind"), F.avg(F.when(~F.col("__kind"), F.col("__delta"))).alias("mean_of_others"),
    )


def visibility(rows: DataFrame, keys: list[str], at: str, order: list[str], visible: Column, hits: int = 3, lead_in: float = 0.2) -> DataFrame:
    """For each track (keys): first_seen, last_seen, first_visible and n. A track becomes visible with its ``hits``-th visible
    row in a run, ``lead_in`` before that row but not before it was first seen (null: never). A dim row before that still
    moves last_seen, one after it doesn't."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__v", F.coalesce(visible, F.lit(False))).withColumn("__dim", F.count_if(~F.col("__v")).over(so_far))
    run = Window.partitionBy(*keys, "__dim").orderBy(at, *order)
    # a run begins behind a dim row, which is the first of its group unless the group is the first
    length = F.row_number().over(run) - F.when(F.col("__dim") > 0, 1).otherwise(0)
    rows = rows.withColumn("__hit", F.col("__v") & (length >= hits))
    rows = rows.withColumn("__before", F.coalesce(F.max("__hit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    out = rows.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(F.when(F.col("__v") | ~F.col("__before"), F.col(at))).alias("last_seen"), F.min(F.when(F.col("__hit"), F.col(at))).alias("__at"), F.count("*").alias("n"))
    return out.withColumn("first_visible", F.when(F.col("__at").isNotNull(), F.greatest("first_seen", F.col("__at") - lead_in))).drop("__at")


def track_match(dy: Column, similarity: Column) -> Column:
    """The score of a row as a track's next one; null where they are too far apart or too unlike."""
    fits = (dy <= 25) & ((similarity > 0.6) | (dy < 10) & (similarity > 0.5))
    return F.when(fits, similarity * 0.7 + (1 - F.least(dy, F.lit(30)) / 30) * 0.3)


def phase_seconds(rows: DataFrame, keys: list[str], at: str, order: list[str], phase: str) -> DataFrame:
    """Seconds spent in each phase of a key: from a row to the next one; the last row's are unknown and count for none."""
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at, *order))
    return rows.withColumn("__s", following - F.col(at)).groupBy(*keys, phase).agg(F.sum("__s").alias("seconds"), F.count("*").alias("n"))


def best_or_error(ranked: DataFrame, keys: list[str], order: list, suitable: Column, message: str = "the best candidate is not suitable", allow: bool = False) -> DataFrame:
    """The first row of each key by ``order``; an error where one is not suitable, unless ``allow``."""
    best = ranked.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
    return best if allow else best.where(F.when(suitable, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
