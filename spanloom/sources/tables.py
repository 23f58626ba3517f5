"""Reading tables, and making this package importable for Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Puts this package's folder on the Python path of workers started from now on.

    That suffices where executors see the same folder (local mode, shared mounts); elsewhere ship it with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data set, with its schema from the Parquet footer; NTZ times stay as they are."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
