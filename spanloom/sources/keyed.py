"""A keyed table as a data source: rows replace those of their key when a write commits, and only then.

``df.write.format("keyed").mode("append").option("path", ...).option("key", ...).save()`` adds one generation of files; the
list of files that count is one small object, ``current.json``, which a commit replaces in one move. So a write that fails
or is tried again leaves the table as it was, and tasks write files of their own. Reading gives the rows of each key's
last generation: every file knows the keys it spans, which filters on the key skip, and ``latest`` leaves out replaced
rows. ``compact`` writes the table anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from .tables import reachable

CURRENT = "current.json"
#: The column that numbers the writes.
GENERATION = "generation"
BATCH_FILE_ROWS = 1 << 20


def listed(path: str) -> dict:
    """What the table consists of: its last generation, and files with their generation, rows and span of keys."""
    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{at}/{CURRENT}").type == fs.FileType.NotFound:
        return {"generation": 0, "files": []}
    with store.open_input_stream(f"{at}/{CURRENT}") as f:
        return json.loads(f.read())


def publish(path: str, content: dict) -> None:
    """Replaces the list of files in one move."""
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at, recursive=True)
    draft = f"{at}/.{CURRENT}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(json.dumps(content).encode())
    store.move(draft, f"{at}/{CURRENT}")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, overwrite: bool):
        self.path, self.key, self.overwrite = path, key, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = fs.FileSystem.from_uri(self.path)
        folder = f"{at}/{self.run}"
        store.create_dir(folder, recursive=True)
        files, out, now = [], None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                now = {"name": f"{self.run}/{uuid.uuid4().hex}.parquet", "rows": 0, "low": None, "high": None, "nulls": False}
                out = pq.ParquetWriter(store.open_output_stream(f"{at}/{now['name']}"), batch.schema)
            out.write_batch(batch)
            keys = batch.column(self.key)
            span = pc.min_max(keys).as_py()
            now["rows"] += batch.num_rows
            now["nulls"] |= keys.null_count > 0
            if span["min"] is not None:
                now["low"] = span["min"] if now["low"] is None else min(now["low"], span["min"])
                now["high"] = span["max"] if now["high"] is None else max(now["high"], span["max"])
            if now["rows"] >= BATCH_FILE_ROWS:
                out.close()
                files.append(now)
                out = None
        if out is not None:
            out.close()
            files.append(now)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        before = {"generation": 0, "files": []} if self.overwrite else listed(self.path)
        generation = listed(self.path)["generation"] + 1
        files = [f | {"generation": generation} for m in messages if m is not None for f in m.files]
        publish(self.path, {"generation": generation, "files": before["files"] + files})

    def abort(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{at}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.run}")


@dataclass
class Piece(InputPartition):
    name: str
    generation: int


class Reader(DataSourceReader):
    """A partition for each file. Filters that compare the key with a value leave out files that can't hold it; Spark checks
    the rows all the same."""

    def __init__(self, path: str, key: str, schema: T.StructType):
        self.path, self.key, self.schema, self.files = path, key, schema, listed(path)["files"]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.files = [x for x in self.files if x["low"] is not None and self.may_hold(f, x["low"], x["high"])]
            yield f

    @staticmethod
    def may_hold(f: Filter, low, high) -> bool:
        if isinstance(f, (EqualTo, In)):
            return any(v is not None and low <= v <= high for v in (f.value if isinstance(f, In) else [f.value]))
        if isinstance(f, GreaterThan):
            return high > f.value
        if isinstance(f, GreaterThanOrEqual):
            return high >= f.value
        return low < f.value if isinstance(f, LessThan) else low <= f.value

    def partitions(self) -> list[Piece]:
        return [Piece(f["name"], f["generation"]) for f in self.files] or [Piece("", 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, at = fs.FileSystem.from_uri(self.path)
        wanted = [f.name for f in self.schema if f.name != GENERATION]
        with store.open_input_file(f"{at}/{partition.name}") as f:
            for b in pq.ParquetFile(f).iter_batches(columns=wanted):
                columns = {n: b.column(n) for n in wanted} | {GENERATION: pa.array([partition.generation] * b.num_rows, pa.int64())}
                yield pa.RecordBatch.from_arrays([columns[x.name] for x in self.schema], names=[x.name for x in self.schema])


class KeyedTable(DataSource):
    """Options: path (a URI that pyarrow opens and all machines share), key (a column of integers or strings)."""

    @classmethod
    def name(cls) -> str:
        return "keyed"

    def schema(self) -> T.StructType:
        files = listed(self.options["path"])["files"]
        if not files:
            raise ValueError(f"no table at {self.options['path']}: give its schema")
        store, at = fs.FileSystem.from_uri(self.options["path"])
        with store.open_input_file(f"{at}/{files[-1]['name']}") as f:
            return from_arrow_schema(pq.read_schema(f)).add(GENERATION, T.LongType())

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self.options["key"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if self.options["key"] not in schema.names or GENERATION in schema.names:
            raise ValueError("the rows need the key, and no column of the generation's name")
        return Writer(self.options["path"], self.options["key"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and lets filters reach it."""
    reachable(spark).dataSource.register(KeyedTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def upsert(df: DataFrame, path: str, key: str) -> None:
    """Rows of df replace those of their keys; all of it, or, if it fails, nothing. Several rows of a key are its new rows.
    One writer at a time: of two at once the later commit would leave out the earlier's."""
    registered(df.sparkSession)
    df.write.format("keyed").mode("append").option("path", path).option("key", key).save()


def generations(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All rows of the table, replaced ones included, with their generation."""
    return registered(spark).read.format("keyed").option("path", path).option("key", key).load()


def latest(spark: SparkSession, path: str, key: str, where: Column | None = None) -> DataFrame:
    """The rows of each key's last generation. ``where`` compares the key with values and is applied before generations are
    compared, so that files which can't hold such keys aren't read; null keys are one key."""
    rows = generations(spark, path, key)
    rows = rows if where is None else rows.where(where)
    last = F.max(GENERATION).over(Window.partitionBy(key))
    return rows.withColumn("__last", last).where(F.col(GENERATION) == F.col("__last")).drop("__last", GENERATION)


def compact(spark: SparkSession, path: str, key: str) -> None:
    """Writes the table's present rows as one generation, sorted by key, in place of all others; their files stay for those
    who still read them."""
    rows = latest(spark, path, key)
    rows.repartitionByRange(key).sortWithinPartitions(key).write.format("keyed").mode("overwrite").option("path", path).option("key", key).save()
