from __future__ import annotations

import random
import time
from copy import deepcopy
from dataclasses import replace
from functools import partial
from itertools import permutations

from spanloom.operators import repairs as rp
from spanloom.operators.repairs import Entry


def spans(entries):
    return [(e.text, e.first, e.last) for e in entries]


def test_overlaps_merge_in_their_lane_only():
    rows = [Entry("hold on", 0, 3, 0), Entry("hold on", 2, 5, 4), Entry("hold on", 2, 5, 90), Entry("let go", 2, 5, 0)]
    assert spans(rp.merge_overlaps(rows, 10)) == [("hold on", 0, 5), ("hold on", 2, 5), ("let go", 2, 5)]
    assert rp.merge_overlaps([], 10) == [] and len(rp.merge_overlaps([Entry("", 0, 3, 0), Entry("", 0, 3, 0)], 10)) == 2


def test_reentries():
    again = [Entry("all the way home", 0, 3, 0), Entry("all the way home", 4, 5, 0)]
    assert spans(rp.merge_reentries(again, 10)) == [("all the way home", 0, 5)]
    taken = [Entry("all the way home", 0, 3, 0), Entry("quite another line", 3, 4, 0), Entry("all the way home", 4, 5, 0)]
    assert len(rp.merge_reentries(taken, 10)) == 3
    assert spans(rp.merge_reentries([Entry("oh no", 0, 2, 0), Entry("oh no", 5, 6, 0)], 10)) == [("oh no", 0, 6)]
    assert len(rp.merge_reentries([Entry("oh no now please", 0, 2, 0), Entry("oh no now please", 5, 6, 0)], 10)) == 2


def test_fades():
    rows = [Entry("down by the", 0.0, 1.0, 0, 0, 90.0), Entry("down by the water", 0.3, 5.0, 0, 1, 230.0)]
    assert spans(rp.merge_fades(rows, 10)) == [("down by the water", 0.0, 5.0)]
    assert len(rp.merge_fades([Entry("one", 0, 1, 0, 0, 90.0), Entry("other thing", 0.3, 5, 0, 1, 230.0)], 10)) == 2


def test_cycles():
    pair = [Entry("round and round", 0, 30, 0), Entry("round and round", 6, 30, 60)]
    got = rp.add_cycles(pair, 10)
    assert [(e.first, e.y, e.inferred) for e in got] == [(0, 0, False), (6, 60, False), (12, 60, True)]
    assert len(rp.add_cycles(got, 10)) == 3


def test_inversions():
    assert rp.repaired_order([5.0, 1.0, 9.0], ["down the road", "down the road", "x"], [0.9, 0.4, 0.5], [0.9, 0.9, 0.9]) == [1, 0, 2]
    assert rp.repaired_order([5.0, 4.5], ["a b", "a b"], [0.9, 0.4], [0.1, 0.1]) == [0, 1] and rp.repaired_order([], [], [], []) == []
    assert rp.repaired_order([5.0, 1.0], ["", "a"], [0.9, 0.4], [0.1, 0.1]) == [0, 1]


def test_passes_keep_columns_and_nulls(spark):
    rows = [(1, "hold on", 0.0, 3.0, 0.0, "p"), (1, "hold on", 2.0, 5.0, 4.0, "q"), (1, None, 1.0, 2.0, 0.0, "r"), (2, "hold on", None, None, None, "s"), (2, "hold on", None, None, None, "t")]
    df = spark.createDataFrame(rows, "k int, text string, first double, last double, y double, tag string")
    got = rp.passes(df, ["k"], [partial(rp.merge_overlaps, lane=10.0), partial(rp.merge_fades, lane=10.0), partial(rp.merge_reentries, lane=10.0), partial(rp.add_cycles, lane=10.0)]).collect()
    assert sorted(r.tag for r in got) == ["p", "r", "s", "t"] and {r.tag: r.last for r in got}["p"] == 5.0
    assert rp.passes(df.limit(0), ["k"], [partial(rp.merge_overlaps, lane=10.0)]).count() == 0


def test_last_match(spark):
    df = spark.createDataFrame([(["take me home", "country roads", "thanks for watching"], ["Take me home", "Country roads"]), (["zzz"], ["take me"]), (None, None)], "a array<string>, b array<string>")
    assert [r.x for r in df.select(rp.last_match("a", "b").alias("x")).collect()] == [1, None, None]


def slow_fades(entries, lane):
    """Every row meets every other one, in order."""
    left = dict(enumerate(entries))
    for i, j in permutations(range(len(entries)), 2):
        if i in left and j in left:
            a, b = left[i], left[j]
            shared = rp.touching(a, b)
            if abs(a.y - b.y) <= lane and shared > 0 and rp.fades(a, b, shared) and rp.one_line(a, b):
                win, lose = (i, j) if a.brightness > b.brightness + 20 or a.length > b.length + 1 else (j, i)
                rp.extend(left[win], left.pop(lose))
    return list(left.values())


def slow_cycles(entries, lane):
    """Every long row meets every later one; whether a turn is there is looked up among all rows."""
    out, long = list(entries), [e for e in entries if e.length >= 6.0]
    for k, a in enumerate(long):
        for b in long[k + 1 :]:
            gap, end = b.first - a.first, min(a.last, b.last)
            at = b.first + gap
            if not 4.0 <= gap <= 10.5 or end - b.first < max(7.0, gap - 0.5) or not b.first + 2 < at < end - 1 or abs(a.y - b.y) <= lane or rp.like(a, b) < 0.97:
                continue
            if not any(abs(x.y - b.y) <= lane and abs(x.first - at) <= 1.2 and rp.like(x, b) >= 0.97 for x in out):
                out.append(replace(b, first=at, last=min(b.last, at + 1.2), inferred=True))
    return sorted(out, key=lambda e: (e.first, e.y))


def made_entries(rng, n, span, lengths):
    made = []
    for k in range(n):
        first = round(rng.uniform(0, span), 2)
        made.append(Entry(rng.choice(["we go home", "we go", "go home now", "river"]), first, round(first + rng.choice(lengths), 2), rng.choice([0.0, 10.0, 30.0]), k, rng.choice([100.0, 150.0, 200.0, 255.0])))
    return sorted(made, key=lambda e: (e.first, e.y, e.text))


def test_fades_and_cycles_equal_slow_ones():
    rng, merged, inferred = random.Random(4), 0, 0
    for _ in range(150):
        rows = made_entries(rng, rng.randint(0, 25), 20, [0.5, 1, 2, 4, 8, 16])
        got = rp.merge_fades(deepcopy(rows), 15.0)
        assert got == slow_fades(deepcopy(rows), 15.0)
        rows = made_entries(rng, rng.randint(0, 25), 20, [8, 16, 20])
        more = rp.add_cycles(deepcopy(rows), 15.0)
        assert more == slow_cycles(rows, 15.0)
        merged, inferred = merged + 25 - len(got), inferred + len(more) - len(rows)
    assert merged > 100 and inferred > 100


def test_a_crowd_of_overlapping_rows_takes_seconds():
    rng, began = random.Random(5), time.process_time()
    rp.merge_fades(made_entries(rng, 10_000, 60, [1, 4, 16]), 15.0)
    rp.add_cycles(made_entries(rng, 10_000, 500, [16]), 15.0)
    assert time.process_time() - began < 30


def test_last_match_takes_arrow_batches():
    import pyarrow as pa

    found, wanted = pa.array([["la la la", "oh yes oh"], None, []] * 300), pa.array([["la la lo"], ["x"], None] * 300)
    assert rp.last_match.func(found, wanted).to_pylist() == [0, None, None] * 300
    assert rp.last_match.func(found[:0], wanted[:0]).to_pylist() == []
