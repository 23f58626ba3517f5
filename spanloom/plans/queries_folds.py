"""Queries of order-dependent passes. Most have no SQL: the tests compare them with plain Python over the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import folds as fo
from spanloom.operators import sweeps as sw
from spanloom.operators import variants as vr
from spanloom.sources.tables import table

from .base import points, query, rounded, spans

#: Seconds of the events' time that count as one, so that times are as close as words in a song.
SLOW = 36_000


@query()
def median_clusters(spark, d):
    """Each user's events as rows on screen, an hour a second, clustered by the medians of their starts and ends."""
    rows = spans(spark, d).select("event_id", "user_id", (F.col("start") / 3600).alias("start"), (F.col("end") / 3600).alias("end"), (F.col("event_id") % 3).cast("double").alias("y"))
    return fo.median_clusters(rows, ["user_id"], "start", "end", "y").select("event_id", "cluster")


@query()
def onset_starts(spark, d):
    """Each user's events as words, its views as onsets: words get onsets one to one, the others stand between them."""
    rows = points(spark, d).withColumn("at", F.col("at") / SLOW)
    words = rows.where("event_type <> 'view'").select("user_id", "event_id", F.col("at").alias("start"), (F.col("at") + F.col("value") / 1000).alias("end"), F.length("event_type").alias("chars"))
    onsets = rows.where("event_type = 'view'").select("user_id", "at")
    found = fo.assign_onsets(words, onsets, ["user_id"], "start", "event_id", "at")
    return rounded(fo.filled_starts(found, ["user_id"], "start", "end", "event_id", "chars").select("event_id", "onset", "new_start", "new_end"))


def turn_options(spark, d, near: int = 12):
    """conv_id, turn, place, choice, cost, sure: a row for each word of a turn and equal word of the turn before that stands
    within ``near`` words of its place. Words that both turns have just once are sure. Joined by word and stretch, both
    sides dealt: a file of a few MB of texts makes rows of far more, which must not be sent whole through the driver."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("n", F.row_number().over(w))
    words = turns.select("conv_id", "n", F.posexplode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("place", "word"))
    words = words.withColumns({"times": F.count("*").over(Window.partitionBy("conv_id", "n", "word")), "stretch": F.floor(F.col("place") / near)})
    before = words.select("conv_id", (F.col("n") + 1).alias("n"), "word", F.col("place").alias("choice"), F.col("times").alias("times_before"), F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    pairs = words.join(before.hint("merge"), ["conv_id", "n", "word", "stretch"]).where(F.abs(F.col("place") - F.col("choice")) <= near)
    return pairs.select("conv_id", F.col("n").alias("turn"), "place", "choice", (F.abs(F.col("place") - F.col("choice")) * 0.1).alias("cost"), ((F.col("times") == 1) & (F.col("times_before") == 1)).alias("sure"))


@query()
def chained_words(spark, d):
    """Each turn's words on those of the turn before: sure ones first, the windows between them by least cost."""
    return fo.chained(turn_options(spark, d), ["conv_id", "turn"], "place", "choice", "cost", "sure")


@query()
def cursor_bags(spark, d):
    """Sentences of each turn on the turns of the conversation, read in order with a cursor."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, d, "conversations").where("conv_id IS NOT NULL").withColumn("n", F.row_number().over(w))
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    bags = turns.select("conv_id", "n", words("text").alias("bag"))
    said = turns.select("conv_id", "n", F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")).alias("k", "line"))
    lines = said.select("conv_id", F.struct("n", "k").alias("s"), words("line").alias("words")).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("s")))
    return rounded(fo.cursor_matches(lines, bags, ["conv_id"], "place", "words", "n", "bag"), 6)


def _silent(spark, d):
    """Each user's views as silences, clicks as gaps between lines, other events as lines, an hour a second."""
    rows = points(spark, d).select("user_id", "event_id", "event_type", (F.col("at") / 3600).alias("at"))
    return [rows.where(p).drop("event_type") for p in ("event_type = 'click'", "event_type = 'view'", "event_type NOT IN ('click', 'view')")]


@query()
def shifts_by_silence(spark, d):
    gaps, silences, _ = _silent(spark, d)
    return rounded(fo.silence_shifts(gaps, silences, ["user_id"], "at", "at"))


@query()
def shifted_lines(spark, d):
    gaps, silences, lines = _silent(spark, d)
    shifts = fo.silence_shifts(gaps, silences, ["user_id"], "at", "at")
    return rounded(fo.shifted_starts(lines, shifts, ["user_id"], "at", "event_id").select("event_id", "new_start"))


def read_lines(spark, d):
    """Each user's events as lines read off a screen, an hour a second: a letter or a word is missing here and there."""
    rows = points(spark, d).select("event_id", "user_id", (F.col("at") / 3600).alias("start"), (F.col("value") / 100).alias("confidence"), "event_type")
    kind = F.when(F.col("event_id") % 4 == 0, F.regexp_replace("event_type", "^(.)(.)", "$1")).otherwise(F.col("event_type"))
    text = F.concat_ws(" ", F.lit("We all"), kind, F.when(F.col("event_id") % 7 != 0, "by"), F.element_at(F.array(*map(F.lit, ("the mill", "the river", "night"))), (F.col("event_id") % 3 + 1).cast("int")))
    rows = rows.withColumn("text", text).withColumn("tokens", F.split(F.lower("text"), " "))
    return rows.withColumn("quality", vr.read_quality(F.col("confidence"), F.when(F.col("event_id") % 5 == 0, 0.3), F.lit(1.0)))


@query()
def canonical_lines(spark, d):
    """Lines that come again, written as their best reading."""
    sure = (F.col("confidence") > 0.6) & (F.col("event_id") % 5 != 0)
    return vr.canonical_variants(read_lines(spark, d), ["user_id"], "event_id", "start", "text", "tokens", "quality", sure).select("event_id", "family", "canonical")


def on_screen(spark, d):
    """Each user's events as rows on screen, four hours a second: few texts of two to six words, short or up to 49 seconds
    long, in five lanes."""
    rows = points(spark, d)
    words = F.element_at(F.array(*map(F.lit, ("we go down to the mill", "the river runs all night long", "oh night", "some say it never ran dry", "nobody knows how old it is"))), (F.floor(F.col("event_id") / 5) % 5 + 1).cast("int"))
    text = F.when(F.col("event_type").isin("view", "click"), "oh night").otherwise(words)
    return rows.select("event_id", "user_id", F.col("event_id").alias("id"), text.alias("text"), (F.col("at") / 14_400).alias("first"), (F.col("at") / 14_400 + F.when(text == "oh night", 1.5 + F.col("value") % 7).otherwise(F.col("value") % 49)).alias("last"), (F.col("event_id") % 5 * 20).cast("double").alias("y"), (text == "oh night").alias("short"))


@query()
def context_epochs(spark, d):
    """Beginnings of long rows that their companions' changes let expect."""
    return rounded(sw.epochs(on_screen(spark, d), ["user_id"], 18.0, few=60).select("user_id", F.col("of").alias("event_id"), "first", "last"))


@query()
def overlap_repetitions(spark, d):
    """Beginnings of rows that stand in two lanes at once for long."""
    return rounded(sw.repetitions(on_screen(spark, d), ["user_id"], 18.0).select("user_id", F.col("of").alias("event_id"), "first", "last"))


def seen_rows(spark, d):
    """The lines of read_lines as rows on screen, up to eight seconds long, in four lanes."""
    rows = read_lines(spark, d)
    return rows.select("event_id", "user_id", F.col("event_id").alias("id"), F.lower("text").alias("text"), (F.col("start") / 4).alias("first"), (F.col("start") / 4 + F.col("confidence") * 2).alias("last"), (F.col("event_id") % 4 * 25).cast("double").alias("y"), (F.col("confidence") > 0.5).alias("visible"))


@query()
def blocks_on_screen(spark, d):
    """Rows of each user that appear together, and their place from top to bottom."""
    return sw.screen_blocks(seen_rows(spark, d), ["user_id"], "first", "last", "y", "id").select("event_id", "block", "row")


@query()
def merged_rows(spark, d):
    """Rows of each user that repeat each other, one left of each."""
    return rounded(sw.merged_repeats(seen_rows(spark, d), ["user_id"]).select("user_id", "id", "text", "first", "last", "rows"))
