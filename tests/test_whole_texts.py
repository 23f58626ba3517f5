"""Queries that take whole texts and tables: against brute force on small fixtures with rows beyond the former cuts."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pytest

from spanloom.plans.registry import QUERIES

N = 450


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    """Two turns of N words that are equal in their last 40 words only, and a turn that starts with the last two."""
    a = [f"a{k}" for k in range(N - 40)] + [f"s{k}" for k in range(40)]
    b = [f"b{k}x" for k in range(N - 40)] + [f"s{k}" for k in range(40)]
    c = b[-2:] + ["end"]
    d = str(tmp_path_factory.mktemp("turns"))
    rows = [(1, k, "user", " ".join(t)) for k, t in enumerate((a, b, c))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, (a, b, c)


def test_turn_alignment_of_long_turns(spark, long_turns):
    d, (a, b, c) = long_turns
    got = {r.turn: r for r in QUERIES["turn_alignment"](spark, d).collect()}
    for turn, x, y in ((1, a, b), (2, b, c)):
        n = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        assert got[turn].f1 == pytest.approx(2 * n / (len(x) + len(y)), abs=1e-6)
        assert got[turn].n_path >= max(len(x), len(y))
    assert got[1].run == 40 and got[1].matched == 40 and got[2].joined == 2


def test_order_dependent_matches_of_long_turns(spark, long_turns):
    d, _ = long_turns
    got = {r.turn: r for r in QUERIES["order_dependent_matches"](spark, d).collect()}
    assert got[1].equal == 40 and got[1].tokens >= 40 and got[2].equal == 2 and got[2].ordered == 2


def test_timed_alignment_of_long_turns(spark, long_turns):
    d, _ = long_turns
    got = {r.turn: r for r in QUERIES["timed_alignment"](spark, d).collect()}
    assert got[1].n == N == got[2].n and got[1].close >= 40


def test_votes_at_every_place(spark, tmp_path):
    texts = [" ".join(f"w{k % 7}" for k in range(30)), " ".join(f"w{k % 5}" for k in range(40)), "a  b"]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    votes: dict[int, Counter] = {}
    for t in texts:
        for k, w in enumerate(t.split(" ")):
            if w:
                votes.setdefault(k, Counter())[w] += 1
    best = {k: min(c.items(), key=lambda x: (-x[1], -len(x[0]), x[0])) for k, c in votes.items()}
    got = {r.place: (r.token, r.votes) for r in QUERIES["positional_vote_everywhere"](spark, str(tmp_path)).collect()}
    assert got == best and len(got) == 40


def test_votes_send_texts_and_no_row_a_word(spark, tmp_path):
    texts = [" ".join(f"w{j}x{(k * j) % 97}" for k in range(2000)) for j in range(60)] + ["", " a  b ", None]
    spark.createDataFrame([(j, t, "s") for j, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    got = {r.place: (r.token, r.votes) for r in QUERIES["positional_vote"](spark, str(tmp_path)).collect()}
    assert written() - before < 60 * 2000 / 7
    votes: dict[int, Counter] = {}
    for t in texts:
        for k, w in enumerate((t or "").split(" ")):
            if w:
                votes.setdefault(k, Counter())[w] += 1
    assert got == {k: min(c.items(), key=lambda x: (-x[1], -len(x[0]), x[0])) for k, c in votes.items()}


def test_frames_and_lookups_use_whole_tables(spark, tmp_path):
    days = ("2024-01-01", "2024-01-03", "2024-01-04", "2024-01-07")
    lines = [(s, n, day, float(s + n)) for s in (1, 2, 3) for n, day in enumerate(days)]
    df = spark.createDataFrame(lines, "l_suppkey long, l_linenumber int, day string, l_quantity double")
    df.selectExpr("l_suppkey", "l_linenumber", "cast(day AS timestamp_ntz) AS l_shipdate", "l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.l_suppkey, r.frame, r.v) for r in QUERIES["filled_ship_days"](spark, str(tmp_path)).collect())
    assert got == [(s, 19724, s + 0.5) for s in (1, 2, 3)]
    spark.createDataFrame([(k, k, 500.0 + 1000 * k) for k in range(8)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k % 9, 600.0) for k in range(18)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.match for r in QUERIES["supplier_with_fallback"](spark, str(tmp_path)).collect()}
    assert got == {k: k % 9 if k % 9 < 8 else None for k in range(18)}
