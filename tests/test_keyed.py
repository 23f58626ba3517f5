from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.sources import keyed


def frame(spark, rows):
    return spark.createDataFrame(rows, "slug string, n int, words array<struct<text: string, start: double>>")


def as_rows(df):
    return sorted((r.slug, r.n, [tuple(w) for w in r.words or ()]) for r in df.collect())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/cache"


def test_rows_replace_those_of_their_key(spark, path):
    keyed.upsert(frame(spark, [("a", 1, [("x", 0.5)]), ("b", 1, []), ("b", 2, None)]), path, "slug")
    keyed.upsert(frame(spark, [("b", 9, [("y", 1.0)]), ("c", 3, [])]), path, "slug")
    assert as_rows(keyed.latest(spark, path, "slug")) == [("a", 1, [("x", 0.5)]), ("b", 9, [("y", 1.0)]), ("c", 3, [])]
    assert keyed.generations(spark, path, "slug").groupBy("generation").count().count() == 2
    keyed.compact(spark, path, "slug")
    assert {f["generation"] for f in keyed.listed(path)["files"]} == {3}
    assert as_rows(keyed.latest(spark, path, "slug")) == [("a", 1, [("x", 0.5)]), ("b", 9, [("y", 1.0)]), ("c", 3, [])]


def test_a_failed_write_leaves_the_table(spark, path, tmp_path):
    keyed.upsert(frame(spark, [("a", 1, [])]), path, "slug")
    before = keyed.listed(path)
    bad = frame(spark, [(f"k{k}", k, []) for k in range(50)]).repartition(4).withColumn("n", F.when(F.col("n") == 37, F.raise_error("broken")).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        keyed.upsert(bad, path, "slug")
    assert keyed.listed(path) == before and as_rows(keyed.latest(spark, path, "slug")) == [("a", 1, [])]
    keyed.upsert(frame(spark, [("a", 2, [])]), path, "slug")
    assert as_rows(keyed.latest(spark, path, "slug")) == [("a", 2, [])]


def test_filters_skip_files(spark, path):
    rows = frame(spark, [(f"s{k:03}", k, []) for k in range(100)]).repartitionByRange(5, "slug")
    keyed.upsert(rows, path, "slug")
    reader = keyed.Reader(path, "slug", rows.schema)
    names = lambda *filters: (reader.__init__(path, "slug", rows.schema), list(reader.pushFilters([*filters])), len(reader.partitions()))[-1]
    assert len(keyed.listed(path)["files"]) == 5 == names()
    assert names(keyed.EqualTo(("slug",), "s050")) == 1 and names(keyed.In(("slug",), ("s000", "s099"))) == 2 and names(keyed.LessThan(("slug",), "s001")) == 1 and names(keyed.GreaterThan(("n",), 5)) == 5
    found = keyed.latest(spark, path, "slug", F.col("slug") == "s050")
    assert as_rows(found) == [("s050", 50, [])]
    assert found.rdd.getNumPartitions() >= 1 and as_rows(keyed.latest(spark, path, "slug", F.col("slug") == "none")) == []


def test_odd_tables(spark, path):
    keyed.upsert(frame(spark, [(None, 1, []), ("a", None, None)]), path, "slug")
    keyed.upsert(frame(spark, [(None, 2, [])]), path, "slug")
    keyed.upsert(frame(spark, []), path, "slug")
    got = keyed.latest(spark, path, "slug").select("slug", "n").collect()
    assert sorted(map(tuple, got), key=str) == [("a", None), (None, 2)]
    with pytest.raises(Exception, match="key"):
        keyed.upsert(spark.range(3), path, "slug")
    with pytest.raises(Exception, match="no table"):
        keyed.latest(spark, path + "-none", "slug").count()
