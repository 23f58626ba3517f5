from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import tracks


def as_rows(df):
    return sorted((str(r.k), round(r.first, 3), round(r.last, 3), r.n, round(r.total, 6), round(r.seen, 3)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, s double, v double").select("k", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"), "v")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, batches, idle, **more):
    """Batches one after the other through one query, each a file and a run of it."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("k int, at timestamp, v double").parquet(str(folder))
        found = tracks.timed_tracks(stream, "k", "at", "v", idle, "2 seconds", **more)
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(f"k int, {tracks.SEEN}").parquet(str(out))


def test_silent_keys_go_by_watermark(rocks, tmp_path):
    """Key 1 falls silent; events of key 2 move the watermark on, which alone commits key 1's track."""
    got = run(rocks, tmp_path, [[(1, 1.0, 5.0), (1, 2.0, 6.0), (2, 2.0, 1.0)], [(2, 20.0, 1.0)], [(2, 40.0, 1.0)]], 3.0)
    assert ("1", 1.0, 2.0, 2, 11.0, 2.0) in as_rows(got)


def test_stream_equals_batch_in_any_order(rocks, tmp_path):
    rng = random.Random(3)
    rows = sorted({(k, round(rng.uniform(0, 60), 1)) for k in range(4) for _ in range(45)}, key=lambda r: r[1])
    rows = [(k, s, float(rng.randint(0, 9))) for k, s in rows] + [(3, 12.3, 7.0), (3, 12.3, 1.0)]
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 1.9))  # within the watermark's two seconds
    end = [(9, 200.0, 0.0)], [(9, 400.0, 0.0)]
    batches = [late[:60], late[60:130], late[130:], *end]
    got = [r for r in as_rows(run(rocks, tmp_path, batches, 2.0, visible=3.0, hits=3)) if r[0] != "9"]
    assert got == as_rows(tracks.timed_tracks_batch(frame(rocks, rows), "k", "at", "v", 2.0, 3.0, 3))
    assert len(got) > 20 and any(r[5] != r[2] for r in got)


def test_batch_tracks_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, 3.0, None), (None, 1.0, 2.0), (1, 5.0, 4.0), (1, 5.0, 4.0), (1, 6.0, 4.0), (1, 9.1, 0.0)], "k int, s double, v double").select("k", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"), "v")
    assert as_rows(tracks.timed_tracks_batch(df, "k", "at", "v", 3.0, 1.0, 3)) == [("1", 5.0, 6.0, 3, 12.0, 5.0), ("1", 9.1, 9.1, 1, 0.0, 9.1), ("None", 1.0, 1.0, 1, 2.0, 1.0)]
    assert tracks.timed_tracks_batch(df.limit(0), "k", "at", "v", 3.0).count() == 0
