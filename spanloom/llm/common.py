"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.sources.tables import reachable, table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set."""
    return table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent and all tasks run in this process's machine (tests, local mode) a folder of this
    machine is chosen and set; on a cluster its absence is an error, since other machines wouldn't see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_left: dict[str, SparkSession] = {}


def at_exit(spark: SparkSession, path: str) -> str:
    """Has the folder deleted when this process ends, if its session still runs then. Returns the path."""
    if not _left:
        atexit.register(_remove_left)
    _left[path] = spark
    return path


def _remove_left() -> None:
    for path, spark in _left.items():
        if spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception:  # noqa: BLE001  the JVM may have gone before: the folder then stays, as after a crash
                return


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts the lineage, survives lost executors. The table
    goes when this process ends; where it is of use inside one function only, see Scratch."""
    path = at_exit(df.sparkSession, shared_dir(df.sparkSession))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stores tables as ``stored`` does and deletes them at the end of its with-block, or earlier one by one."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        path = at_exit(df.sparkSession, shared_dir(df.sparkSession))
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that this object stored."""
        held, path = self.paths.pop(id(df))
        remove(held.sparkSession, path)
        _left.pop(path, None)

    def __exit__(self, *_) -> None:
        for df, _ in list(self.paths.values()):
            self.drop(df)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case: ``name`` with underscores in front."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a task holds the results of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_columns_from(
    df: DataFrame,
    inputs: list[str],
    fields: T.StructType,
    make: Callable[[], Callable[..., list[list]]],
    rows: int = 256,
    keep: list[str] | None = None,
) -> DataFrame:
    """df with the columns ``fields``, computed in Arrow batches from the columns ``inputs``.

    ``make`` runs once in each task and returns the function that maps lists of input values to lists of output
    values. Columns of df named like an output (in any case) are replaced; others pass through, or those in ``keep``:
    what isn't needed later should not be among them, since all that passes goes to Python and back.
    """
    made = {f.name.lower() for f in fields}
    passed = [f for f in df.schema if f.name.lower() not in made and (keep is None or f.name in keep)]
    names = [f.name for f in passed] + [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    through = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in slices(batches, rows):
            out = work(*(b.column(c).to_pylist() for c in inputs))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in through] + [pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=names
            )

    reachable(df.sparkSession)
    needed = list(dict.fromkeys([*through, *inputs]))
    return df.select(*needed).mapInArrow(run, T.StructType([*passed, *fields.fields]))


#: Values that a key is folded to before it is sent to all tasks: so many entries at most, whatever the input holds.
FOLDED = 1 << 20


def folded(*keys: str | Column) -> Column:
    """A number below FOLDED that rows with equal keys (nulls too) share."""
    return F.pmod(F.xxhash64(*keys), F.lit(FOLDED))


def split_by(df: DataFrame, key: Column, named: DataFrame, named_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose folded key some row of ``named`` has, the other rows). No row whose key is named is among the others;
    some of the first have another key. What is sent to the tasks is at most FOLDED numbers; where the names are so many
    that most numbers occur, most rows are among the first, and nothing is gained or lost."""
    at = free_name(df, "__at")
    numbers = F.broadcast(named.select(named_key.alias(at)).distinct())
    rows = df.withColumn(at, key)
    return rows.join(numbers, at, "left_semi").drop(at), rows.join(numbers, at, "left_anti").drop(at)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
