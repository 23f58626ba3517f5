from __future__ import annotations

import random
from collections import defaultdict
from itertools import product
from statistics import median

import pytest
from pyspark.sql import functions as F

from spanloom.operators import folds
from spanloom.plans import queries_folds
from spanloom.plans.registry import QUERIES


def groups(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


# clusters


def slow_clusters(rows):
    """(start, end, y) rows: every cluster is looked at, its medians taken anew."""
    clusters, of = [], []
    for s, e in rows:
        k = next((k for k, c in enumerate(clusters) if abs(s - median(x for x, _ in c)) <= 2.0 and abs(e - median(y for _, y in c)) <= 3.0), len(clusters))
        clusters += [[]] if k == len(clusters) else []
        clusters[k].append((s, e))
        of.append(k)
    return of


def test_median_clusters_equal_slow_ones(spark, small):
    got = {r.event_id: r.cluster for r in QUERIES["median_clusters"](spark, small).collect()}
    rows = queries_folds.spans(spark, small).collect()
    for own in groups(rows, "user_id").values():
        own.sort(key=lambda r: (r.start / 3600, float(r.event_id % 3), r.end / 3600))
        assert [got[r.event_id] for r in own] == slow_clusters([(r.start / 3600, r.end / 3600) for r in own])
    assert len(got) == len(rows)


def test_median_clusters_of_dense_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k % 2, k, round(rng.uniform(0, 40), 2), 0.0, float(rng.randint(0, 3))) for k in range(700)]
    rows = [(u, k, s, round(s + rng.uniform(0, 9), 2), y) for u, k, s, _, y in rows] + [(None, 900, 1.0, 2.0, 0.0), (0, 901, None, 2.0, 0.0), (0, 902, 3.0, None, None)]
    df = spark.createDataFrame(rows, "user long, id long, s double, e double, y double")
    got = {r.id: r.cluster for r in folds.median_clusters(df, ["user"], "s", "e", "y").collect()}
    assert got[900] == 0 and got[901] is None and got[902] is None
    for u in (0, 1):
        own = sorted((r for r in rows if r[0] == u and None not in r), key=lambda r: (r[2], r[4], r[3]))
        assert [got[r[1]] for r in own] == slow_clusters([(r[2], r[3]) for r in own])
    assert folds.median_clusters(df.limit(0), ["user"], "s", "e", "y").count() == 0


def test_running_median():
    rng, m, seen = random.Random(1), folds.Median(), []
    for _ in range(300):
        x = rng.choice([rng.random(), rng.randint(0, 5)])
        m.add(x)
        seen.append(x)
        assert m.value == pytest.approx(median(seen))


# onsets


def slow_onsets(words, onsets):
    """Words as (start, chars, end) in order: every onset not passed is tried for each."""
    onsets, given, first = sorted(onsets), [], 0
    for i, (start, _, _) in enumerate(words):
        best = None
        for j in range(first, len(onsets)):
            far = abs(onsets[j] - start) + (2.0 if onsets[j] < start - 0.5 else 0.0)
            short = len(words) - i - 1 > 0 and len(onsets) - j - 1 < len(words) - i - 1
            if (short or far <= 2.0) and (best is None or far < best[0]):
                best = far, j
        if best is None or best[0] >= 3.0:
            given.append(None)
            continue
        given.append(onsets[best[1]])
        first = best[1] + 1
        while first < len(onsets) and onsets[first] < given[-1] + 0.3:
            first += 1
    starts, length = list(given), lambda k: max(0.15, min(0.08 * words[k][1], 0.5))
    for i in reversed(range(len(words))):
        if starts[i] is None:
            after = next((s for s in starts[i + 1 :] if s is not None), None)
            if after is not None:
                starts[i] = after - length(i)
            else:
                starts[i] = starts[i - 1] + length(i - 1) if i and starts[i - 1] is not None else words[i][0]
    out = []
    for s in starts:
        out.append(s if not out or s > out[-1] else out[-1] + 0.1)
    ends = [b - 0.02 for b in out[1:]] + [words[-1][2]] if words else []
    return [(o, s, max(e, s + 0.1)) for o, s, e in zip(given, out, ends, strict=True)]


def test_onset_starts_equal_slow_ones(spark, small):
    got = {r.event_id: (r.onset, r.new_start, r.new_end) for r in QUERIES["onset_starts"](spark, small).collect()}
    rows, matched = queries_folds.points(spark, small).collect(), 0
    for own in groups(rows, "user_id").values():
        at = {r.event_id: r.at / queries_folds.SLOW for r in own}
        words = sorted((r for r in own if r.event_type != "view"), key=lambda r: (at[r.event_id], r.event_id))
        want = slow_onsets([(at[r.event_id], len(r.event_type), at[r.event_id] + r.value / 1000) for r in words], [at[r.event_id] for r in own if r.event_type == "view"])
        for r, w in zip(words, want, strict=True):
            assert got[r.event_id] == pytest.approx(tuple(None if x is None else round(x, 4) for x in w), abs=2e-4)
            matched += w[0] is not None
    assert matched > 20 and len(got) == sum(r.event_type != "view" for r in rows)


def test_onsets_of_dense_and_odd_rows(spark):
    rng = random.Random(5)
    words = [(u, k, round(rng.uniform(0, 12), 2), 0.0, rng.randint(1, 9)) for u in range(12) for k in range(rng.randint(1, 30))]
    onsets = [(u, round(rng.uniform(-1, 13), 2)) for u in range(11) for _ in range(rng.randint(1, 30))] + [(3, None), (None, 1.0), (99, 1.0)]
    df = spark.createDataFrame([*words, (5, 77, None, 0.0, 3)], "u long, k long, s double, e double, n int")
    found = folds.assign_onsets(df, spark.createDataFrame(onsets, "u long, at double"), ["u"], "s", "k", "at")
    assert found.where("k = 77").first().onset is None and found.count() == len(words) + 1
    got = {(r.u, r.k): (r.onset, r.new_start, r.new_end) for r in folds.filled_starts(found, ["u"], "s", "e", "k", "n").collect()}
    for (u,), own in groups(spark.createDataFrame(words, df.schema).collect(), "u").items():
        own.sort(key=lambda r: (r.s, r.k))
        want = slow_onsets([(r.s, r.n, r.e) for r in own], [o for v, o in onsets if v == u and o is not None])
        for r, w in zip(own, want, strict=True):
            assert got[u, r.k] == pytest.approx(w)
    empty = folds.assign_onsets(df.limit(0), spark.createDataFrame(onsets, "u long, at double"), ["u"], "s", "k", "at")
    assert empty.count() == 0


# chains


def price(path, costs):
    back = [0.0 if b >= a - 1 else 0.55 + 0.14 * (a - 1 - b) for a, b in zip(path, path[1:], strict=False)]
    return sum(back) + sum(c[p] for p, c in zip(path, costs, strict=True))


@pytest.mark.parametrize("anchors", [0.0, 0.4])
def test_chains_equal_exhaustive_search(spark, anchors):
    rng, rows, want = random.Random(7), [], {}
    for u in range(60):
        costs, fixed = [], []
        for place in range(rng.randint(1, 6)):
            own = {c: round(rng.uniform(0, 1.5), 3) for c in rng.sample(range(12), rng.randint(1, 4))}
            sure = min(own, key=lambda c: (own[c], c)) if rng.random() < anchors else None
            rows += [(u, place * 2, c, x, c == sure) for c, x in own.items()] + [(u, place * 2, next(iter(own)), 9.0, False)]
            costs.append({sure: own[sure]} if sure is not None else own)
            fixed.append(sure)
        want[u] = min(price(p, costs) for p in product(*costs)), costs
    df = spark.createDataFrame([*rows, (1, None, 3, 0.1, False), (1, 0, None, 0.1, False), (1, 0, 3, None, True)], "u long, place int, choice int, cost double, sure boolean")
    got = groups(folds.chained(df, ["u"], "place", "choice", "cost", "sure").collect(), "u")
    for u, (least, costs) in want.items():
        own = sorted(got[(u,)], key=lambda r: r.place)
        assert [r.place for r in own] == [2 * k for k in range(len(costs))]
        assert price([r.choice for r in own], costs) == pytest.approx(least)
    assert folds.chained(df.limit(0), ["u"], "place", "choice", "cost").count() == 0


def test_chained_words_cost_least(spark, small):
    """Against a program that looks at every pair of options of neighbouring places."""
    options = groups(queries_folds.turn_options(spark, small).collect(), "conv_id", "turn")
    got = groups(QUERIES["chained_words"](spark, small).collect(), "conv_id", "turn")
    assert options.keys() == got.keys()
    for key, rows in options.items():
        places = groups(rows, "place")
        costs = []
        for place in sorted(places):
            sure = [r for r in places[place] if r.sure]
            costs.append({r.choice: r.cost for r in (sure or places[place])})
        total = dict(costs[0])
        for now in costs[1:]:
            total = {c: x + min(t + (0.0 if c >= p - 1 else 0.55 + 0.14 * (p - 1 - c)) for p, t in total.items()) for c, x in now.items()}
        path = [r.choice for r in sorted(got[key], key=lambda r: r.place)]
        assert price(path, costs) == pytest.approx(min(total.values()))


def test_co_ordered_merges_in_order(spark):
    left = spark.createDataFrame([(1, 2.0, "a"), (1, 5.0, "b"), (None, 1.0, "c"), (1, None, "d")], "k long, at double, name string")
    right = spark.createDataFrame([(1, 2.0, 7), (1, 4.0, 8), (2, 0.0, 9)], "k long, t double, n int")

    def fold(events):
        seen = []
        for is_left, r in events:
            if is_left:
                yield {"name": r["name"], "seen": list(seen)}
            else:
                seen.append(r["n"])

    from pyspark.sql import types as T

    schema = T.StructType().add("name", T.StringType()).add("seen", T.ArrayType(T.IntegerType()))
    got = {r.name: r.seen for r in folds.co_ordered(left, right, ["k"], F.col("at"), F.col("t"), fold, schema).collect()}
    assert got == {"a": [7], "b": [7, 8], "c": [], "d": []}


# cursors and shifts


def test_cursor_bags_equal_list_version(spark, small):
    import re

    got = {(r.conv_id, r.place): (r.bag, r.share) for r in QUERIES["cursor_bags"](spark, small).collect()}
    words = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    rows, seen = groups(spark.read.parquet(f"{small}/conversations.parquet").collect(), "conv_id"), 0
    for (conv,), turns in rows.items():
        turns.sort(key=lambda r: (r.turn, r.role, r.text))
        bags = [words(t.text) for t in turns]
        lines = [x for t in turns for x in re.split(r"(?<=[.!?])\s+", t.text) if x]
        cursor, ahead = 0, max(10, len(bags) // 4)
        for k, line in enumerate(lines):
            w = words(line)
            shares = [(len(w & b) / len(w) if w else 0.0) for b in bags[cursor : cursor + ahead]]
            best = max(shares)
            cursor += shares.index(best) if best > 0 else 0
            assert got[conv, k + 1] == (cursor + 1, pytest.approx(best, abs=1e-6))
            seen += 1
    assert seen == len(got)


def test_shifts_equal_list_version(spark, small):
    events = groups(queries_folds.points(spark, small).collect(), "user_id")
    shifts = groups(QUERIES["shifts_by_silence"](spark, small).collect(), "user_id")
    moved = {r.event_id: r.new_start for r in QUERIES["shifted_lines"](spark, small).collect()}
    for key, own in events.items():
        at = lambda *kinds, own=own: sorted((r.at / 3600, r.event_id) for r in own if r.event_type in kinds)
        offset, want = 0.0, []
        for end, _ in at("click"):
            far, z = min(((abs(z - end - offset), z) for z, _ in at("view")), default=(99.0, 0.0))
            if far < 20:
                offset = z - end
                want.append((end, offset))
        assert sorted((r.at, r.shift) for r in shifts[key]) == [pytest.approx(w, abs=1e-3) for w in want]
        last = None
        for start, event in at("error", "signup", "purchase"):
            new = start + next((o for e, o in reversed(want) if e <= start), 0.0)
            last = new if last is None else max(last, new)
            assert moved[event] == pytest.approx(last, abs=1e-3)
    assert sum(map(len, shifts.values())) > 20


def test_cursor_and_shifts_of_odd_rows(spark):
    lines = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, None), (1, 2, ["z"]), (1, None, ["a"]), (2, 0, ["a"]), (1, 3, ["c", "c", "d"])], "k int, n int, t array<string>")
    bags = spark.createDataFrame([(1, 0, ["x"]), (1, 1, ["b"]), (1, 2, ["a", "b"]), (1, 3, None), (1, 4, ["c"])], "k int, m int, b array<string>")
    got = {(r.k, r.n): (r.bag, r.share) for r in folds.cursor_matches(lines, bags, ["k"], "n", "t", "m", "b").collect()}
    assert got == {(1, 0): (2, 1.0), (1, 1): (2, 0.0), (1, 2): (2, 0.0), (1, 3): (4, 0.5), (2, 0): (None, 0.0)}
    times = spark.createDataFrame([(1, None), (2, 5.0)], "k int, at double")
    assert folds.silence_shifts(times, times.where("k = 1"), ["k"], "at", "at").count() == 0
    rows = spark.createDataFrame([(1, 7, None), (1, 8, 2.0), (1, 9, 1.0)], "k int, id int, s double")
    out = folds.shifted_starts(rows, folds.silence_shifts(times, times, ["k"], "at", "at"), ["k"], "s", "id").collect()
    assert {r.id: r.new_start for r in out} == {7: None, 8: 2.0, 9: 1.0}


def test_options_are_not_sent_to_all_tasks(spark, small):
    """A file of a few MB of texts makes rows of far more."""
    from spanloom.plans.queries_folds import turn_options

    assert "BroadcastHashJoin" not in turn_options(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_similar_tokens_are_not_sent_to_all_tasks(spark, small):
    assert "BroadcastHashJoin" not in QUERIES["token_similarity_pairs"](spark, small)._jdf.queryExecution().executedPlan().toString()
