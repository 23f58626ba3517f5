from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import rules as ru
from spanloom.functions import text as tx
from spanloom.operators import aggregates as ag
from spanloom.operators import align as al
from spanloom.operators import entity as en
from spanloom.operators import intervals as iv
from spanloom.operators import joins as jn
from spanloom.sources import lrc
from spanloom.streaming import tracks


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_coalesce_merges_touching(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 3.0, 4.0), (1, None, 9.0), (2, 0.0, 5.0), (2, 1.0, 2.0), (2, 4.0, 6.0)], "k int, start double, end double")
    assert pairs(iv.coalesce(df, ["k"]), "k", "start", "end") == [(1, 0.0, 2.0), (1, 3.0, 4.0), (2, 0.0, 6.0)]
    assert pairs(iv.coalesce(iv.coalesce(df, ["k"]), ["k"]), "k", "start", "end") == pairs(iv.coalesce(df, ["k"]), "k", "start", "end")


def test_complement(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0)], "k int, start double, end double")
    w = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 1.0), (3, 2.0, 1.0)], "k int, low double, high double")
    assert pairs(iv.complement(df, w, ["k"]), "k", "start", "end") == [(1, 0.0, 1.0), (1, 2.0, 3.0), (1, 4.0, 5.0), (2, 0.0, 1.0)]


def test_intervals_without_length(spark):
    """Without overlap they part a gap in two, and inside another set's interval they are a piece, as in the SQL."""
    points = spark.createDataFrame([(1, 3.0, 3.0), (1, 5.0, 5.0), (1, 0.0, 0.0), (1, 9.0, 9.0), (2, 1.0, 1.0)], "k int, start double, end double")
    whole = spark.createDataFrame([(1, 0.0, 4.0), (1, 5.0, 9.0), (2, 1.0, 1.0)], "k int, start double, end double")
    w = spark.createDataFrame([(1, 0.0, 9.0)], "k int, low double, high double")
    assert pairs(iv.complement(points, w, ["k"]), "k", "start", "end") == [(1, 0.0, 3.0), (1, 3.0, 5.0), (1, 5.0, 9.0)]
    assert pairs(iv.intersect(points, whole, ["k"]), "k", "start", "end") == [(1, 3.0, 3.0)] == pairs(iv.intersect(whole, points, ["k"]), "k", "start", "end")


def test_measure_splits_by_a_set(spark):
    rng = random.Random(5)
    make = lambda n: spark.createDataFrame([(k, s := rng.uniform(0, 100), s + rng.uniform(0, 9)) for k in range(4) for _ in range(n)], "k int, start double, end double")
    a, b = iv.coalesce(make(12), ["k"]), iv.coalesce(make(9), ["k"])
    w = a.groupBy("k").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    whole = dict(pairs(iv.measure(a, ["k"]), "k", "total"))
    inside = dict(pairs(iv.measure(iv.intersect(a, b, ["k"]), ["k"]), "k", "total"))
    outside = dict(pairs(iv.measure(iv.intersect(a, iv.complement(b, w, ["k"]), ["k"]), ["k"]), "k", "total"))
    for k, total in whole.items():
        assert abs(total - inside.get(k, 0) - outside.get(k, 0)) < 1e-9


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k int, start double, end double")
    assert iv.coalesce(none, ["k"]).count() == 0 == iv.intersect(none, none, ["k"]).count()
    assert en.drop_adjacent_repeats(none.withColumn("t", F.lit("x")), ["k"], "start", "end", "t").count() == 0


def test_weighted_mean_and_percentiles(spark):
    df = spark.createDataFrame([(0.62, 100.0), (0.78, 50.0), (None, 7.0), (0.5, 0.0)], "v double, w double")
    assert round(df.agg(ag.weighted_mean("v", "w").alias("x")).first().x, 4) == 0.6733
    p = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double").agg(ag.percentile("v", 0.95).alias("a"), ag.percentile_nearest_rank("v").alias("b")).first()
    assert (round(p.a, 9), p.b) == (8.95, 10.0)
    assert df.where("false").agg(ag.percentile("v", 0.95).alias("a"), ag.weighted_mean("v", "w").alias("b")).first() == (0.0, None)


def test_mode_takes_the_first_seen(spark):
    df = spark.createDataFrame([(0, 2), (1, 2), (2, 1), (3, 1)], "i int, v int").withColumn("k", F.lit(1))
    assert ag.mode_first_seen(df, ["k"], "v", "i").first().v == 2


def test_as_of_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "k int, at double")
    right = spark.createDataFrame([(1, 8.0, 3.0), (1, 8.0, 2.0), (1, 12.0, 1.0)], "k int, at double, v double")
    assert pairs(jn.nearest(left, right, ["k"], "at", "v").where("v IS NOT NULL"), "k", "at", "v") == [(1, 10.0, 2.0), (1, 20.0, 1.0)]
    assert jn.as_of(left, right, ["k"], "at", "v", "backward", 1.0).where("v IS NOT NULL").count() == 0


def test_lyric_stamps(spark):
    rows = spark.createDataFrame([("[01:02.5] a",), ("[1:02.123]b",), ("[00:61.00] c",), ("none",)], "t string")
    assert [r.s for r in rows.select(lrc.stamp_seconds(F.col("t")).alias("s")).collect()] == [62.5, 62.123, None, None]


def test_lyric_headers_and_scan(spark):
    files = spark.createDataFrame([("f", "[ar: X]\n[ar:Y]\n[00:01.00]Written by: Some One\n[00:20.00]la\n[00:21.00]♪\nplain")], "p string, t string")
    assert files.select(lrc.tag(F.col("t"), "ar").alias("a")).first().a == "Y"
    assert pairs(lrc.scan(files, "p", "t"), "start", "line") == [(20.0, "la")]
    songs = spark.createDataFrame([("f", "Old Mill", "The Weirs", "[00:00.50]Old Mill\n[00:00.90]The Weirs (band)\n[00:11.00]text 12345 now\n[00:13.00]text 12345 now\n[00:14.00]Everyone will love the song Old Mill.\n[00:16.00]Old Mill, Old Mill")], "p string, title string, artist string, t string")
    kept = lambda **more: [r.start for r in lrc.scan(songs, "p", "t", title=F.col("title"), artist=F.col("artist"), **more).orderBy("line_idx").collect()]
    assert kept() == [13.0, 16.0] and kept(promos=False) == [11.0, 13.0, 14.0, 16.0] and len(kept(drop_metadata=False)) == 6


def test_titles_made_outside_a_studio(spark):
    titles = {"Song (Live at Wembley)": True, "Song - Radio Edit": False, "Song BBC Radio Session": True, "Song (Album Version)": False, "Old Mill": False, "Delivery": True, "Old Mill 1999 Concert": True, "Mill on MTV": True, "Mill at the Blue Hall": True}
    rows = spark.createDataFrame([(t,) for t in [*titles, None]], "t string").select("t", ru.is_non_studio(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == titles | {None: False}


def test_noise_on_screen(spark):
    lines = {"www.karafun.com": True, "visit sing.com": False, "xorafun karaone": True, "xorafun": False, "all rights reserved copyright": True, "rights reserved": False, "one two three four five six seven eight rights reserved": True, "we all go home": False, "": False, "kara kara": False}
    rows = spark.createDataFrame([(t,) for t in [*lines, None]], "t string").select("t", ru.is_screen_noise(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == lines | {None: False}


def test_lines_without_lyrics(spark):
    lines = {"♪ 🎵 ·=•": "symbols", "  ": "symbols", "*": None, "♬♫ x": None, "Writer: Some One": "credit", "Two words: Some One": None, "Verylongfirstword1: Some One": None, "word: Élan": None, "mail me@home": "promo", "me @ home": None, "send an SMS": "promo", "call 06 12 34": "promo", "in 12345": None, "in 123456": "promo", "Remember members": None}
    c = F.col("t")
    kind = F.when(tx.is_symbols_only(c), "symbols").when(tx.has_credit(c), "credit").when(tx.is_promo(c), "promo")
    assert {r.t: r.k for r in spark.createDataFrame([(t,) for t in lines], "t string").select("t", kind.alias("k")).collect()} == lines


def test_text_forms(spark):
    row = spark.createDataFrame([("Héllo-World! It's  (live) [x]",)], "t string")
    got = row.select(tx.basic(F.col("t")).alias("b"), tx.line(F.col("t")).alias("l"), tx.matching("t").alias("m"), tx.slug(F.lit("--"), F.lit("id")).alias("s")).first()
    assert (got.b, got.l, got.m, got.s) == ("hllo world it's  live x", "h llo world it's", "hello world it s live x", "id")


def test_similarity_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    assert [r.s for r in df.select(al.similarity("a", "b").alias("s")).collect()] == [SequenceMatcher(None, "tide", "diet").ratio(), SequenceMatcher(None, "diet", "tide").ratio(), 0.0]


def test_warping_path_is_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cost = rng.integers(0, 4, (rng.integers(1, 6), rng.integers(1, 6))).astype(float)
        path = al.warping_path(cost)
        assert path[0] == (0, 0) and path[-1] == (cost.shape[0] - 1, cost.shape[1] - 1)

        def best(i, j):
            if i < 0 or j < 0:
                return 0.0 if i == j == -1 else np.inf
            return cost[i, j] + min(best(i - 1, j - 1), best(i - 1, j), best(i, j - 1))

        assert sum(cost[i, j] for i, j in path) == best(cost.shape[0] - 1, cost.shape[1] - 1)


def test_stream_and_batch_tracks_agree(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, float(t), rng.random()) for k in range(3) for t in sorted(rng.sample(range(1000), 60))]
    df = spark.createDataFrame(rows, "k int, t double, v double")
    batch = tracks.track_batch(df, "k", "t", "v", 20.0)
    whole = []
    for k in range(3):
        done, still = tracks.fold_tracks([t for i, t, _ in rows if i == k], [v for i, _, v in rows if i == k], 20.0, None)
        whole += [(k, *x) for x in [*done, still]]
    assert [(r[:4], round(r[4], 9)) for r in pairs(batch, "k", "first", "last", "n", "total")] == [(r[:4], round(r[4], 9)) for r in sorted(whole)]


def test_screen_noise_takes_words_apart_once(spark):
    df = spark.createDataFrame([("www.karafun.com",)], "t string").select(ru.is_screen_noise(F.col("t")).alias("x"))
    assert df._jdf.queryExecution().analyzed().toString().count("[^a-z0-9]+") == 1


def test_mixed_costs_are_those_of_each_pair():
    rng = random.Random(8)
    a, b = (["".join(rng.choice("abcdéxyz") for _ in range(rng.randint(1, 7))) for _ in range(40)] for _ in "ab")
    s, t = np.arange(40) * 0.9, np.arange(40) * 0.7
    apart = np.minimum(np.abs(np.subtract.outer(s, t)) / 20, 1.0)
    want = [[0.7 * (1 - SequenceMatcher(None, x, y).ratio() if apart[i, j] < 1 else 1.0) + 0.3 * apart[i, j] for j, y in enumerate(b)] for i, x in enumerate(a)]
    assert np.array_equal(al.mixed_cost(a, s, b, t), np.array(want))


def test_runtime_profile_sorts_no_rows_for_a_window(spark, small):
    from spanloom.plans.registry import QUERIES

    assert "Window" not in QUERIES["runtime_profile"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_unicode_forms_take_arrow_batches():
    import pyarrow as pa

    texts = pa.array(["\u201cCaf\u00e9\u201d  \u2014 x", None, ""] * 300)
    assert tx.canonical.func(texts).to_pylist() == ['"Caf\u00e9" - x', None, ""] * 300
    assert tx.matching.func(texts).to_pylist() == ["cafe x", None, ""] * 300 and tx.matching.func(texts[:0]).to_pylist() == []
