"""Queries that have no SQL, against plain Python over the same rows; and new functions on small made rows."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from difflib import SequenceMatcher
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import diagnosis as di
from spanloom.functions import lines as ln
from spanloom.functions import rules as ru
from spanloom.operators import align as al
from spanloom.operators import joins as jn
from spanloom.operators import repairs as rp
from spanloom.operators import timing as tm
from spanloom.plans.queries_repairs import _entries
from spanloom.plans.registry import QUERIES
from spanloom.sources import manifest


@pytest.fixture(scope="module")
def turns(spark, small):
    """conversation: [(turn, role, text)] in order."""
    out: dict = {}
    for r in sorted(spark.read.parquet(f"{small}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return out


def words(text: str) -> list[str]:
    return text.lower().split()


def pairs_of(turns):
    """(conversation, turn, text before, text) of successive turns."""
    return [(c, b[0], a[2], b[2]) for c, ts in turns.items() for a, b in zip(ts, ts[1:], strict=False)]


def naive_path(cost):
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((total[i - 1, j - 1], 0, (i - 1, j - 1)), (total[i - 1, j], 1, (i - 1, j)), (total[i, j - 1], 2, (i, j - 1))))[2]
    return path[::-1]


def test_warping_by_diagonals_equals_cell_by_cell():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n, m = rng.integers(1, 12, 2)
        cost = rng.integers(0, 3, (n, m)).astype(float) if rng.random() < 0.5 else rng.random((n, m))
        assert al.warping_path(cost) == naive_path(cost) == al.guarded_path(cost, None)
        assert al.warping_path(cost, 50) == naive_path(cost)


def test_turn_alignment(spark, small, turns):
    got = {(r.conv_id, r.turn): r for r in QUERIES["turn_alignment"](spark, small).collect()}
    assert len(got) == len(pairs_of(turns))
    for c, t, before, text in pairs_of(turns):
        a, b, r = words(before), words(text), got[c, t]
        cost = np.array([[float(x != y) for y in b] for x in a])
        path = naive_path(cost) if a and b else []
        assert (r.n_path, r.total, r.matched) == (len(path), sum(cost[p] for p in path), sum(cost[p] == 0 for p in path))
        run = max((next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j)) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]), default=0)
        assert r.run == run and r.joined == max(k for k in range(4) if k == 0 or len(a) >= k <= len(b) and a[-k:] == b[:k])


def test_token_similarity_pairs(spark, small, turns):
    tokens = lambda text: {w for w in re.split(r"[\W\d_]+", text.lower()) if len(w) >= 6 and w.isalpha()}
    want = {}
    for ts in turns.values():
        for a in {w for _, role, t in ts if role == "user" for w in tokens(t)}:
            for b in {w for _, role, t in ts if role == "assistant" for w in tokens(t)}:
                if (r := SequenceMatcher(None, a, b).ratio()) >= 0.8:
                    want[a, b] = round(r, 6)
    got = {(r.a, r.b): r.similarity for r in QUERIES["token_similarity_pairs"](spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_no_similar_tokens_are_missed(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(3, 12)))
    a, b = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    frames = [spark.createDataFrame([(1, x) for x in xs], f"k int, {c} string") for xs, c in ((a, "a"), (b, "b"))]
    for least in (0.7, 0.8, 1.0):
        got = {(r.a, r.b) for r in jn.similar_tokens(*frames, ["k"], "a", "b", least).collect()}
        assert {(x, y) for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= least} <= got


def test_matched_texts(spark, small):
    plain = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})
    got = {r.doc_id: (r.canonical, r.matching) for r in QUERIES["matched_texts"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        canonical = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", r.text).translate(plain)).strip()
        bare = [c for c in unicodedata.normalize("NFD", r.text.lower()) if not unicodedata.combining(c)]
        matching = " ".join("".join(c if c.isalnum() else " " for c in bare).split())
        assert got[r.doc_id] == tuple(hashlib.md5(x.encode()).hexdigest() for x in (canonical, matching))


def users(spark, small):
    rows: dict = {}
    for r in _entries(spark, small).collect():
        rows.setdefault(r.user_id, []).append(r)
    return rows


def test_merged_entries_lose_nothing_at_the_cuts(spark, small):
    """The steps over all rows of a user at once, as the query's stretches give them."""
    steps = [partial(rp.merge_overlaps, lane=15.0), partial(rp.merge_fades, lane=15.0), partial(rp.merge_reentries, lane=15.0)]
    want = []
    for rows in users(spark, small).values():
        rows = sorted(rows, key=lambda r: (r["first"], r.y, r.text))
        entries = [rp.Entry(r.text, r["first"], r["last"], r.y, k, r.light) for k, r in enumerate(rows)]
        for step in steps:
            entries = step(entries)
        want += [(rows[e.row].event_id, round(e.first, 3), round(e.last, 3)) for e in entries]
    got = [(r.event_id, r["first"], r["last"]) for r in QUERIES["merged_entries"](spark, small).collect()]
    assert sorted(i for i, _, _ in got) == sorted(i for i, _, _ in want)
    assert all(abs(x - y) < 2e-3 for g, w in zip(sorted(got), sorted(want), strict=True) for x, y in zip(g, w, strict=True))


def test_inferred_cycles(spark, small):
    want = []
    for rows in users(spark, small).values():
        rows = sorted(rows, key=lambda r: (r["first"], r.y, r.text))
        long = [(r.event_id, r.text, r["first"], r["first"] + 24, r.y) for r in rows]
        out = [(x, f, la, y) for _, x, f, la, y in long]
        for k, (i, x, f, la, y) in enumerate(long):
            for j, x2, f2, la2, y2 in long[k + 1 :]:
                gap, end, begun = abs(f - f2), min(la, la2), max(f, f2)
                at = begun + gap
                if not (4 <= gap <= 10.5 and end - begun >= max(7.0, gap - 0.5) and begun + 2 < at < end - 1) or abs(y - y2) <= 15 or SequenceMatcher(None, x, x2).ratio() < 0.97:
                    continue
                n, text, lane, last = (i, x, y, la) if f >= f2 else (j, x2, y2, la2)
                if not any(abs(b - lane) <= 15 and abs(t - at) <= 1.2 and SequenceMatcher(None, a, text).ratio() >= 0.97 for a, t, _, b in out):
                    out.append((text, at, min(last, at + 1.2), lane))
                    want.append((n, at))
    got = sorted((r.event_id, r["first"]) for r in QUERIES["inferred_cycles"](spark, small).collect())
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 for a, b in zip(got, sorted(want), strict=True))


def test_repaired_inversions(spark, small):
    want = {}
    for rows in users(spark, small).values():
        rows.sort(key=lambda r: (r.event_id, r["first"]))
        order = list(range(len(rows)))
        for _ in range(4):
            for k in range(len(order) - 1):
                a, b = (rows[order[k + x]] for x in (0, 1))
                r = SequenceMatcher(None, a.text, b.text).ratio()
                q = abs(a.light - b.light) / 250
                short = len(a.text.split()) <= 3 and len(b.text.split()) <= 4 and min(a.light, b.light) / 250 < 0.45
                if a["first"] > b["first"] + 0.75 and (r >= 0.82 or short) and (r >= 0.9 or q >= 0.05):
                    order[k], order[k + 1] = order[k + 1], order[k]
        want |= {rows[k].event_id: place for place, k in enumerate(order)}
    assert {r.event_id: r.new_place for r in QUERIES["repaired_inversions"](spark, small).collect()} == want


def test_weaker_repeats(spark, small):
    rows: dict = {}
    for r in spark.read.parquet(f"{small}/events.parquet").collect():
        rows.setdefault(r.user_id, []).append((r.ts, f"seen a {r.event_type}", r.value / 100, r.event_id))
    left = []
    for events in rows.values():
        events.sort(key=lambda e: (e[0], e[1]))
        gone = set()
        for i, (t, x, q, _) in enumerate(events):
            for j in range(i + 1, min(i + 5, len(events))):
                u, y, p, _ = events[j]
                if i in gone or j in gone or (u - t).total_seconds() > 43200:
                    continue
                if abs(q - p) >= 0.18 and SequenceMatcher(None, x, y).ratio() >= 0.84:
                    gone.add(i if q < p else j)
        left += [e[3] for k, e in enumerate(events) if k not in gone]
    assert sorted(r.event_id for r in QUERIES["weaker_repeats"](spark, small).collect()) == sorted(left)


def test_trimmed_to_match(spark, small, turns):
    split = lambda t: [x for x in re.split(r"(?<=[.!?])\s+", t) if x]
    got = {(r.conv_id, r.turn): (r["lines"], r["last"]) for r in QUERIES["trimmed_to_match"](spark, small).collect()}
    for c, t, before, text in pairs_of(turns):
        a, b = split(text), split(before)
        hits = [k for k, x in enumerate(a) if any(x and y and SequenceMatcher(None, x.lower(), y.lower()).ratio() >= 0.45 for y in b)]
        assert got[c, t] == (len(a), max(hits, default=None))


def test_rule_tables_are_the_callers(spark):
    df = spark.createDataFrame([(1, 5.0, True), (2, None, None)], "k int, x double, y boolean")
    score, labels = di.weighed([("big", 2.0, "x > 3"), ("told", -0.5, "y"), ("small", 1.0, "x < 1")])
    assert [(r.s, r.n) for r in df.select(score.alias("s"), labels.alias("n")).collect()] == [(1.5, ["big", "told"]), (0.0, [])]
    assert [r[0] for r in df.select(di.first_case([("a", "x > 9"), ("b", "y")], "none")).collect()] == ["b", "none"]


def test_titles_and_keywords(spark):
    cases = [
        ("The River is the best song, River!", "River", True), ("Listen to our new song River, out now!", "River", True), ("Watch “River” by nobody we know at all", "river", True),
        ("River runs through the town of mine.", "River", False), ("Go River.", "River", False), ("no such thing here at all, is there?", "River", False), ("anything at all, it goes on.", "", False), (None, "x", False), ("x", None, False),
    ]
    df = spark.createDataFrame(cases, "line string, title string, want boolean")
    assert all(r.want == r.got for r in df.select("want", ru.repeats_title(F.col("line"), F.col("title")).alias("got")).collect())
    lines = spark.createDataFrame([("Composer : someone", True), ("composers: x", False), ("the writer:7", False), ("a Producer:Bob", True)], "line string, want boolean")
    assert all(r.want == r.got for r in lines.select("want", ru.has_keyword(F.col("line")).alias("got")).collect())
    titles = spark.createDataFrame([("Ann - Song (Official Video)",), ("Ann – Song [Remastered]",), ("Just a Song Lyrics",), ("A - B | C",), ("",)], "t string")
    assert [tuple(r[0]) for r in titles.select(ln.title_parts(F.col("t"))).collect()] == [("Ann", "Song"), ("Ann", "Song"), (None, "Just a Song"), ("A", "B | C"), (None, "")]
    names = spark.createDataFrame([("Ann & Bob",), ("ann lee",), ("B",), ("Zoe",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(ln.singer_id(F.col("n"), ["Ann", "Bob"])).collect()] == ["both", "singer1", "singer2", "singer1", "unknown", "unknown"]


def test_visibility_step_by_step(spark):
    rng = random.Random(8)
    rows = [(k, t, rng.random() < 0.55) for k in range(40) for t in range(rng.randint(1, 12))]
    want = {}
    for k in range(40):
        hits, seen, first_visible, last = 0, False, None, None
        for _, t, vis in [r for r in rows if r[0] == k]:
            if vis:
                last, hits = t, hits + 1
            else:
                last, hits = (last if seen else t), 0
            if not seen and hits >= 3:
                first_visible, seen = max(0, t - 0.2), True
        want[k] = (0, last, first_visible)
    got = tm.visibility(spark.createDataFrame([(k, float(t), v) for k, t, v in rows], "k int, t double, v boolean"), ["k"], "t", ["t"], F.col("v")).collect()
    assert {r.k: (r.first_seen, r.last_seen, r.first_visible) for r in got} == want


def test_unsuitable_best_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "k int, q double")
    assert tm.best_or_error(df, ["k"], [F.desc("q")], F.col("q") > 0.3).count() == 1
    assert tm.best_or_error(df, ["k"], [F.desc("q")], F.col("q") > 0.5, allow=True).count() == 1
    with pytest.raises(Exception, match="not suitable"):
        tm.best_or_error(df, ["k"], [F.desc("q")], F.col("q") > 0.5).collect()


def test_manifest(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("songs:\n- {artist: A, title: T, youtube_id: 1x, youtube_url: u, clip_tags: [a, ''], lyrics_file: l.lrc, audio_start_sec: }\n- {artist: 5, title: T, youtube_id: y, youtube_url: u, clip_duration_sec: 3}\n")
    got = manifest.read_manifest(spark, f"{tmp_path}/m.yaml").collect()
    assert [(r.manifest_index, r.artist, r.clip_tags, r.audio_start_sec, r.clip_duration_sec) for r in got] == [(1, "A", ["a"], 0.0, None), (2, "5", [], 0.0, 3.0)]
    assert got[0].lyrics_file == f"{tmp_path}/l.lrc"
    with pytest.raises(ValueError, match="lacks youtube_url"):
        manifest.rows_of({"songs": [{"artist": "A", "title": "T", "youtube_id": "1"}]})
    with pytest.raises(ValueError, match="mapping"):
        manifest.rows_of([])
