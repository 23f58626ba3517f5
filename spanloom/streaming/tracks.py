"""Streaming forms: session windows and a stateful tracker with idle eviction."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators.islands import number_islands


def session_counts(events: DataFrame, keys: list[str], at: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Sessions of a stream (or a batch): keys, start, end (last event plus gap), n. Events later than ``lateness`` behind
    the watermark are dropped by Spark; in a batch none are."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    out = rows.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


TRACK = "first double, last double, n bigint, total double"


class Tracker(StatefulProcessor):
    """One open track per key: events within ``idle`` seconds of its last one extend it, a later one commits it and opens
    the next. What is open at the end of a finite input stays in state."""

    def __init__(self, idle: float, key: str, at: str, value: str):
        self.idle, self.key, self.at, self.value = idle, key, at, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("track", TRACK)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.at)
        held = self.state.get() if self.state.exists() else None
        done, track = fold_tracks(events[self.at], events[self.value], self.idle, held)
        if track is not None:
            self.state.update(track)
        yield pd.DataFrame([(key[0], *t) for t in done], columns=[self.key, "first", "last", "n", "total"])

    def close(self) -> None:
        pass


def fold_tracks(times, values, idle: float, track: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Committed tracks (first, last, n, total) and the one still open, after events in order of time."""
    done = []
    for t, v in zip(times, values, strict=True):
        if track is not None and t - track[1] > idle:
            done.append(tuple(track))
            track = None
        track = (float(t), float(t), 1, float(v)) if track is None else (track[0], float(t), track[2] + 1, track[3] + float(v))
    return done, track


class TimedTracker(StatefulProcessor):
    """One open track per key, by event time. Events wait in state, counted by their time, until the watermark has passed
    them; then they are folded in order, so neither the order in which they arrive nor how batches fall matters. A key's
    track is committed when the watermark passes its last event by more than ``idle``, also if no event of the key comes
    any more: its timer sees to that, and leaves no state behind.

    A track counts as seen from its ``hits``-th event in a row with a value of ``visible`` or more; ``seen`` is the first
    of these, and the last event's time where that never happens.
    """

    WAITING, OPEN = "n bigint, total double, low double", "first bigint, last bigint, n bigint, total double, run bigint, run_from bigint, seen bigint"

    def __init__(self, idle: float, key: str, at: str, value: str, visible: float, hits: int):
        self.idle, self.key, self.at, self.value, self.visible, self.hits = round(idle * 1000), key, at, value, visible, hits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", self.WAITING)
        self.open = handle.getValueState("open", self.OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:  # a key's rows come in several frames; each is let go
            known = frame.dropna(subset=[self.at, self.value])
            ms = known[self.at].astype("datetime64[ms]").astype("int64")
            for t, g in known[self.value].groupby(ms):
                n, total, low = self.waiting.getValue((t,)) if self.waiting.containsKey((t,)) else (0, 0.0, float("inf"))
                self.waiting.updateValue((t,), (n + len(g), total + float(g.sum()), min(low, float(g.min()))))
                self.handle.registerTimer(int(t))
        yield pd.DataFrame(columns=[self.key, "first", "last", "n", "total", "seen"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        track, done = (tuple(self.open.get()) if self.open.exists() else None), []
        due = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator() if k[0] <= now)
        for t, (n, total, low) in due:
            if track is not None and t - track[1] > self.idle:
                done.append(track)
                track = None
            track = self.extended(track, t, n, total, low)
            self.waiting.removeKey((t,))
        if track is not None and now - track[1] > self.idle:
            done.append(track)
            track = None
        if track is None:
            self.open.clear()
        else:
            self.open.update(track)
            if due:
                self.handle.registerTimer(track[1] + self.idle + 1)
        out = [(key[0], f / 1000, last / 1000, n, total, (last if seen is None else seen) / 1000) for f, last, n, total, _, _, seen in done]
        yield pd.DataFrame(out, columns=[self.key, "first", "last", "n", "total", "seen"])

    def extended(self, track: tuple | None, t: int, n: int, total: float, low: float) -> tuple:
        """A track with the n events of one time; their least value says whether they are visible."""
        first, _, m, sums, run, since, seen = track or (t, t, 0, 0.0, 0, t, None)
        run, since = (run + n, since if run else t) if low >= self.visible else (0, t)
        return first, t, m + n, sums + total, run, since, since if seen is None and run >= self.hits else seen

    def close(self) -> None:
        pass


SEEN = "first double, last double, n bigint, total double, seen double"


def timed_tracks(events: DataFrame, key: str, at: str, value: str, idle: float, lateness: str = "10 seconds", visible: float = float("-inf"), hits: int = 3) -> DataFrame:
    """Committed tracks of a stream: key, first, last, n, total, seen (seconds since 1970; see TimedTracker). ``at`` is a
    timestamp; events more than ``lateness`` behind the latest are dropped. Keys may be null; rows without time or value
    count for nothing. Needs the RocksDB state store."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, at, value).withWatermark(at, lateness)
    return rows.groupBy(key).transformWithStateInPandas(TimedTracker(idle, key, at, value, visible, hits), f"{key} {kind}, {SEEN}", outputMode="Append", timeMode="EventTime")


def timed_tracks_batch(events: DataFrame, key: str, at: str, value: str, idle: float, visible: float = float("-inf"), hits: int = 3) -> DataFrame:
    """The same tracks of a finite input, the open ones included, in DataFrame functions."""
    ms = F.floor(F.col(at).cast("double") * 1000) / 1000
    times = events.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(key, ms.alias("t"), F.col(value).cast("double").alias("v")).groupBy(key, "t").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"))
    w = Window.partitionBy(key).orderBy("t")
    rows = number_islands(times.withColumn("__gap", F.col("t") - F.lag("t").over(w)), [key], ["t"], F.coalesce(F.col("__gap") > idle, F.lit(False)), "track")
    in_track = Window.partitionBy(key, "track").orderBy("t")
    upto = in_track.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.count_if(F.col("low") < visible).over(upto))  # rows since the last that isn't visible have one number
    in_run = Window.partitionBy(key, "track", "run").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"hit": F.sum(F.when(F.col("low") >= visible, F.col("n")).otherwise(0)).over(in_run), "since": F.min(F.when(F.col("low") >= visible, F.col("t"))).over(in_run)})
    out = rows.groupBy(key, "track").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min_by("since", F.when(F.col("hit") >= hits, F.col("t"))).alias("seen"))
    return out.select(key, "first", "last", "n", "total", F.coalesce("seen", "last").alias("seen"))


def track_stream(events: DataFrame, key: str, at: str, value: str, idle: float) -> DataFrame:
    """Committed tracks of a stream: key, first, last, n, total. ``at`` is in seconds."""
    kind = events.schema[key].dataType.simpleString()
    return events.select(key, at, value).groupBy(key).transformWithStateInPandas(Tracker(idle, key, at, value), f"{key} {kind}, {TRACK}", outputMode="Append", timeMode="None")


def track_batch(events: DataFrame, key: str, at: str, value: str, idle: float) -> DataFrame:
    """The same tracks of a finite input, the open ones included, in DataFrame functions."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at))
    rows = number_islands(events.select(key, at, value).withColumn("__gap", gap), [key], [at], F.col("__gap") > idle, "track")
    return rows.groupBy(key, "track").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.sum(value).alias("total")).drop("track")
