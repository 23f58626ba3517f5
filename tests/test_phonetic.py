from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom.functions import phonetic as ph
from spanloom.plans.registry import QUERIES


def test_spoken_forms(spark):
    forms = {"I'm  gonna GO, too": "i am gonna go to", "They're there for four": "they are their for for", "Élan, vital!": "elan vital", "Hmm... uhh": "mm uh", "": "", "don't_stop": "dont_stop"}
    rows = spark.createDataFrame([(t,) for t in [*forms, None]], "t string").select("t", ph.spoken_form(F.col("t")).alias("f"), ph.spoken_form(F.col("t"), english=False).alias("g")).collect()
    assert {r.t: r.f for r in rows} == forms | {None: None}
    assert {r.t: r.g for r in rows}["They're there for four"] == "theyre there for four"


def test_spoken_similarity(spark):
    pairs = [("too", "two"), ("river", "rivers"), ("night", "knight"), ("remember", "remembers"), ("a b", "c d"), ("", "x"), (None, "x"), ("aye", "eye")]
    got = spark.createDataFrame(pairs, "a string, b string").select(ph.spoken_similarity(F.col("a"), F.col("b")).alias("s"), ph.with_skeletons(F.lit(0.1), F.col("a"), F.col("b")).alias("k")).collect()
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert [r.s for r in got] == pytest.approx([1.0, ratio("river", "rivers"), ratio("night", "knight"), 0.95, ratio("a b", "c d"), 0.0, 0.0, ratio("aye", "eye")])
    assert [r.k for r in got][:3] == pytest.approx([0.95, 0.95 * ratio("rvr", "rvrs"), 0.95 * ratio("nght", "knght")]) and got[-1].k == pytest.approx(0.1)


def test_spoken_pairs_equal_plain_ones(spark, small):
    got = {r.p_partkey: (r.score, r.best) for r in QUERIES["spoken_pairs"](spark, small).collect()}
    bones = lambda t: "".join(c for c in t if c not in "aeiouy")
    for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_name", "p_type").collect():
        x, y = (" ".join(ph.ALIKE.get(w, ph.CONTRACTIONS.get(w, w)) for w in "".join(c for c in t.lower() if c.isalnum() or c in " _").split()) for t in (r.p_name, r.p_type))
        score = SequenceMatcher(None, x, y).ratio()
        best = max(score, 0.95 * SequenceMatcher(None, bones(x), bones(y)).ratio())
        assert got[r.p_partkey] == pytest.approx((score, best), abs=1e-5)
