"""Reports and caches as files: reading with explicit schemas, newest-file choice, and idempotent writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A timing document: lines with words.
TIMING = "schema_version STRING, title STRING, artist STRING, lines ARRAY<STRUCT<line_index: INT, text: STRING, start: DOUBLE, `end`: DOUBLE, words: ARRAY<STRUCT<word_index: INT, text: STRING, start: DOUBLE, `end`: DOUBLE>>>>"


def read_json(spark: SparkSession, path: str, schema: str = TIMING) -> DataFrame:
    """Documents, one a file, with ``path``; what can't be parsed gives nulls, not an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))


def slugs_of_results(spark: SparkSession, path: str, suffix: str = "_result.json") -> DataFrame:
    """Distinct slugs in names like ``<number>_<slug><suffix>``."""
    name = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", rf"^[^_]*_(.*)\Q{suffix}\E$", 1).alias("slug"))
    return name.where("slug <> ''").distinct()


def newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the file written last (ties: the greatest name)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_modification_time").alias("__t"), F.col("_metadata.file_path").alias("__p"))
    top = rows.agg(F.max(F.struct("__t", "__p")).alias("top"))
    return rows.join(F.broadcast(top), F.struct("__t", "__p") == F.col("top")).drop("__t", "__p", "top")  # one row


def best_ranked(df: DataFrame, keys: list[str], ranks: list[str], order: str) -> DataFrame:
    """Per key the row with the lexicographically greatest ranks; the first in order among equals."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(r).desc_nulls_last() for r in ranks), order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overwrite_by_key(df: DataFrame, path: str, key: str) -> None:
    """Writes a table partitioned by ``key``; partitions that df holds are replaced, others stay. Safe to repeat."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def markdown(df: DataFrame, most: int = 50) -> str:
    """A table of the first rows of a small report."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
