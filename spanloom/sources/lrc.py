"""Timed lyric files: scan, headers, duration and validity, all as column expressions over whole-file text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.rules import is_metadata
from spanloom.functions.scoring import estimated_duration

STAMP = r"\[(\d+):(\d{1,2})\.(\d{1,3})\]"


def stamp_seconds(text: Column) -> Column:
    """Seconds of the first ``[m:ss.fff]`` in a text: the fraction scales by its own digits; 60 seconds or more, or no
    stamp, give null."""
    part = lambda k: F.regexp_extract(text, STAMP, k)
    fraction = part(3).try_cast("double") / F.pow(F.lit(10.0), F.length(part(3)))
    return F.when(text.rlike(STAMP) & (part(2).try_cast("int") < 60), part(1).try_cast("double") * 60 + part(2).try_cast("double") + fraction)


def scan(files: DataFrame, key: str, text: str, drop_metadata: bool = True, title: Column | None = None, artist: Column | None = None, promos: bool = True) -> DataFrame:
    """key, line_idx, start, line: a row per stamped line, in file order, without unstamped and empty ones and, if wished,
    without metadata lines (``rules.is_metadata``; ``title`` and ``artist`` are columns of ``files``, unknown ones null)."""
    none = F.lit(None).cast("string")
    rows = files.select(key, (none if title is None else title).alias("__title"), (none if artist is None else artist).alias("__artist"), F.posexplode(F.split(text, r"\r?\n")).alias("line_idx", "raw"))
    rows = rows.select(key, "line_idx", stamp_seconds(F.trim("raw")).alias("start"), F.trim(F.regexp_replace("raw", r"\[[^\]]*\]", "")).alias("line"), "__title", "__artist").where("start IS NOT NULL")
    if drop_metadata:
        rows = rows.where(~is_metadata(F.col("line"), F.col("__title"), F.col("__artist"), F.col("start"), promos=promos))
    return rows.drop("__title", "__artist")


def tag(text: Column, name: str) -> Column:
    """The last ``[name:...]`` header of a file; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?i)\[{name}:\s*([^\]]*)\]"), F.lit(1)), F.lit(-1))


def durations(rows: DataFrame, key: str) -> DataFrame:
    """Per file: lines, first and last start, estimated duration, and the first reason why it is not usable."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))
    out = out.withColumn("duration", estimated_duration(F.col("last"), F.col("last") - F.col("first")))
    return out.withColumn("reason", F.when(F.col("n") < 5, "too few lines").when(F.col("last") - F.col("first") < 30, "too short"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """path and text of lyric files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
