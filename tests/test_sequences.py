from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom.operators import entity as en
from spanloom.operators import sequences as sq
from spanloom.operators import suppress as sp
from spanloom.sources import records
from spanloom.streaming import tracks


def one(spark, column, **arrays):
    kinds = ", ".join(f"{k} {'array<double>' if k.endswith('t') else 'array<string>'}" for k in arrays)
    return spark.createDataFrame([tuple(arrays.values())], kinds).select(column.alias("x")).first().x


def test_greedy_pairs_take_each_line_once(spark):
    got = one(spark, sq.greedy_pairs("a", "b"), a=["hello there", "hello there", "zzz"], b=["hello there!", "hello then", "other"])
    assert [(p.i, p.j) for p in got] == [(0, 0), (1, 1)]


def test_token_matches_prefer_equal_ones(spark):
    got = one(spark, sq.token_matches("a", "b"), a=["walking", "run", "walked"], b=["walkin", "run", "walking"])
    assert [(p.i, p.j) for p in got] == [(0, 2), (1, 1)]


def test_two_pointers_stop_at_the_first_miss(spark):
    assert [(p.i, p.j) for p in one(spark, sq.two_pointer_lines("a", "b"), a=["a", "x", "b", "c"], b=["a", "b", "q", "c"])] == [(0, 0), (2, 1)]
    assert one(spark, sq.two_pointer_lines("a", "b"), a=None, b=["a"]) == []


def test_windowed_alignment_is_monotone():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(60)]
    other = [w for w in words if rng.random() < 0.8]
    got = sq.windowed_alignment(words, [0.4 * k for k in range(60)], other, [0.4 * k for k in range(len(other))])
    assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
    assert sum(words[i] == other[j] for i, j in got) >= 0.7 * len(other)


def test_equal_blocks(spark):
    a, b = list("abcabx"), list("xabcab")
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    assert [(p.i, p.j) for p in one(spark, sq.equal_blocks("a", "b"), a=a, b=b)] == [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]


def test_soft_overlap(spark):
    assert one(spark, sq.soft_overlap("a", "b"), a=["walking", "home"], b=["walkin", "x", "y"]) == pytest.approx(1 / 3)
    assert one(spark, sq.soft_overlap("a", "b"), a=[], b=["x"]) == 0.0


def test_optional_tokens(spark):
    df = spark.createDataFrame([("la (oh (yeah) no) fin",), (None,)], "t string")
    got = df.select(sq.optional_tokens("t").alias("x")).collect()
    assert [(p.token, p.optional) for p in got[0].x] == [("la", False), ("oh", True), ("yeah", True), ("no", True), ("fin", False)] and got[1].x == []


def test_budgets_and_retiming(spark):
    assert one(spark, sq.capped_durations(F.col("dt"), F.lit(5.0), 2.0), dt=[1.0, 3.0, 0.5, 4.0]) == [1.0, 2.0, 0.5, 1.5]
    df = spark.createDataFrame([([(1.0, 2.0), (2.0, 3.0)],)], "w array<struct<start: double, `end`: double>>")
    row = df.select(sq.retimed(F.col("w"), F.lit(1.0), F.lit(0.5)).alias("a"), sq.reflowed(F.col("w"), F.lit(0.0), F.lit(4.0)).alias("b")).first()
    assert [tuple(x) for x in row.a] == [(1.0, 1.5), (1.5, 2.0)] and [tuple(x) for x in row.b] == [(0.0, 1.8), (2.0, 3.8)]


def test_suppression_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(3), rng.uniform(0, 60), rng.uniform(0, 10)) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, k int, start double, v double")
    got = {r.id for r in sp.drop_explained(df, F.col("v") < 4, F.col("v") >= 8, ["k"], "id", 2.5).collect()}
    assert got == {i for i, k, s, v in rows if not (v < 4 and any(k2 == k and v2 >= 8 and abs(s2 - s) <= 2.5 for _, k2, s2, v2 in rows))}


def test_sequential_passes(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 1.1, 2.0, "a"), (1, 2.15, 3.0, "a"), (1, 2.9, 3.1, "b")], "k int, start double, end double, t string")
    assert sorted(r.start for r in en.drop_adjacent_repeats(df, ["k"], "start", "end", "t", 0.2).collect()) == [0.0, 2.15, 2.9]
    moved = en.push_overlaps(df, ["k"], "start", "end").orderBy("new_start").collect()
    assert all(b.new_start >= a.new_end + 0.02 - 1e-12 for a, b in zip(moved, moved[1:], strict=False))


def test_files(spark, tmp_path):
    doc = '{"title": "T", "lines": [{"line_index": 1, "text": "a b", "start": 0.5, "end": 1.0, "words": []}]}'
    for name, text in (("1_my-song_result.json", doc), ("2_my-song_result.json", doc), ("3_bad_result.json", "not json"), ("other.json", "{}")):
        (tmp_path / name).write_text(text)
    rows = records.read_json(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and sum(r.title == "T" for r in rows) == 2
    assert {r.slug for r in records.slugs_of_results(spark, str(tmp_path)).collect()} == {"my-song", "bad"}
    assert records.newest(spark, str(tmp_path), "title STRING").count() >= 1
    out = str(tmp_path / "table")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    records.overwrite_by_key(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), out, "k")
    records.overwrite_by_key(spark.createDataFrame([(2, "c")], "k int, v string"), out, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}
    assert records.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 |  |\n"


def test_tracker_on_a_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, float(t), 1.0) for k in range(3) for t in sorted(rng.sample(range(500), 40))]
    halves = [[r for r in rows if r[1] < 250], [r for r in rows if r[1] >= 250]]
    folder = tmp_path / "in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame(halves[0], "k int, at double, v double").coalesce(1).write.parquet(f"{folder}/a")
        stream = spark.readStream.schema("k int, at double, v double").option("recursiveFileLookup", True).parquet(str(folder))
        start = lambda: tracks.track_stream(stream, "k", "at", "v", 15.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        start().awaitTermination(120)
        spark.createDataFrame(halves[1], "k int, at double, v double").coalesce(1).write.parquet(f"{folder}/b")
        start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.k, r["first"], r["last"], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.k, r["first"], r["last"], r.n) for r in tracks.track_batch(spark.createDataFrame(rows, "k int, at double, v double"), "k", "at", "v", 15.0).collect()}
    still_open = {k: max(t for i, _, t, _ in batch if i == k) for k in range(3)}
    assert got == {b for b in batch if b[2] != still_open[b[0]]}


def test_session_window_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 100), (2, 3)], "k int, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    tracks.session_counts(stream, ["k"], "ts", "10 seconds", "0 seconds").writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.k, r.n) for r in spark.table("sessions_out").collect()}
    assert (1, 2) in got and {(r.k, r.n) for r in tracks.session_counts(df, ["k"], "ts", "10 seconds").collect()} == {(1, 2), (1, 1), (2, 1)}


def test_bounds_keep_every_pair_that_reaches_the_ratio():
    from spanloom.operators.sequences import may_pair, ratio

    rng = random.Random(4)
    words = ["".join(rng.choice("abcé\U0001f600" if n % 9 == 0 else "abcd") for _ in range(rng.randint(0, 9))) for n in range(60)]
    for least in (0.8, 0.86):
        may = may_pair(words[:30], words[30:], least)
        assert all(may[i, j] for i, a in enumerate(words[:30]) for j, b in enumerate(words[30:]) if ratio(a, b) >= least)
        assert not may.all()


def test_soft_overlap_takes_equal_tokens_that_a_similar_one_has_not_taken():
    import pandas as pd

    from spanloom.operators.sequences import soft_overlap

    left, right = [["abcdef", "abcdeg", "abcdeg"], ["x"], None], [["abcdeg", "abcdeh", "zz"], ["y"], ["a"]]
    assert list(soft_overlap.func(pd.Series(left), pd.Series(right))) == [2 / 3, 0.0, 0.0]


def test_matching_many_words_takes_no_comparison_of_each_pair(monkeypatch):
    """Words that share too few letters are not compared."""
    import pandas as pd

    from spanloom.operators import sequences as sq

    asked = []
    monkeypatch.setattr(sq, "ratio", lambda a, b: asked.append((a, b)) or 0.0)
    left, right = [[f"{c}" * 6 for c in "abcdefgh"]], [[f"{c}" * 6 for c in "ijklmnop"]]
    assert len(sq.token_matches.func(pd.Series(left), pd.Series(right))[0]) == 0 and sq.soft_overlap.func(pd.Series(left), pd.Series(right))[0] == 0.0
    assert asked == []
