from __future__ import annotations

import random
from collections import defaultdict
from difflib import SequenceMatcher

from spanloom.operators import sweeps
from spanloom.plans import queries_folds
from spanloom.plans.registry import QUERIES

like = lambda a, b: SequenceMatcher(None, a, b).ratio()


def present(out, text, y, t, near):
    return any(x["text"] == text and abs(x["y"] - y) <= near and abs(x["first"] - t) <= 1.2 for x in out)


def slow_epochs(rows, near, few=60):
    """Every long row looks at all rows of its key."""
    rows = sorted(rows, key=lambda r: (r["first"], r["y"], r["id"]))
    out, found = list(rows), []
    for a in rows:
        if len(a["text"].split()) < 4 or a["short"] or a["last"] - a["first"] < 5.5:
            continue
        others = [r for r in rows if r is not a and like(r["text"], a["text"]) < 0.85 and abs(r["y"] - a["y"]) > 16 and a["first"] - 0.2 <= r["first"] <= a["last"] + 0.2]
        if len(others) < 2 or len({r["text"].split()[0] for r in others if r["text"].split()}) < 2:
            continue
        if sum(x["text"] == a["text"] and abs(x["y"] - a["y"]) <= near for x in rows) >= few:
            continue
        starts, family, at = [], None, None
        for r in others:
            t, now = r["first"], " ".join(r["text"].split()[:3])
            if t <= a["first"] + 2.0 or t >= a["last"] - 0.8 or not now:
                continue
            if family is not None and now != family and t - at >= 1.1 and not (starts and t - starts[-1] < 2.2):
                starts.append(t)
            family, at = now, t
        for t in starts[:2]:
            if not present(out, a["text"], a["y"], t, near):
                out.append({"text": a["text"], "y": a["y"], "first": t})
                found.append((a["id"], round(t, 4), round(min(a["last"], t + 1.2), 4)))
    return sorted(found)


def slow_repetitions(rows, near):
    """Every pair of rows of a key looks at all rows of it."""
    rows = sorted(rows, key=lambda r: (r["first"], r["y"], r["id"]))
    out, found, jobs = list(rows), [], []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            start, end = max(a["first"], b["first"]), min(a["last"], b["last"])
            da, db = a["last"] - a["first"], b["last"] - b["first"]
            if a["short"] or b["short"] or a["text"] != b["text"] or abs(a["y"] - b["y"]) <= near or end - start < 3.0 or max(da, db) < 8.0:
                continue
            anchor, other = (a, b) if da >= db else (b, a)
            if other["first"] - anchor["first"] < 4.0:
                continue
            refrain = [r for r in rows if r["short"] and start <= r["first"] <= end]
            if len(refrain) < 3:
                continue
            low, high = sorted((a["y"], b["y"]))
            mid = [r for r in refrain if low + 10 <= r["y"] <= high - 10]
            source = mid if len(mid) >= 2 else refrain
            least, starts = other["first"] + 2.2, []
            for r in source:
                if r["first"] > least and (not starts or r["first"] - starts[-1] >= 3.0):
                    starts.append(r["first"])
            if len(starts) < 2:
                longest = max(source, key=lambda r: r["last"] - r["first"])
                if longest["last"] - longest["first"] >= 6.0:
                    t = max(least, longest["first"] + 2.2)
                    while t <= min(end - 1.0, longest["last"] - 1.0):
                        if not starts or t - starts[-1] >= 3.0:
                            starts.append(t)
                        t += 4.0
            before = None
            for r in rows:
                if start <= r["first"] <= end and not r["short"] and like(r["text"], anchor["text"]) < 0.9 and r["first"] > least:
                    if (before is None or r["first"] - before >= 1.4) and not any(abs(r["first"] - s) < 1.6 for s in starts):
                        starts.append(r["first"])
                    before = r["first"]
            jobs += [(anchor["first"], anchor["id"], t, anchor) for t in sorted(starts)[:6]]
    for _, _, t, a in sorted(jobs, key=lambda j: j[:3]):
        if not present(out, a["text"], a["y"], t, near):
            out.append({"text": a["text"], "y": a["y"], "first": t})
            found.append((a["id"], round(t, 4), round(min(a["last"], t + 1.2), 4)))
    return sorted(found)


def check(spark, small, name, slow):
    got, by_user, n = defaultdict(list), defaultdict(list), 0
    for r in QUERIES[name](spark, small).collect():
        got[r.user_id].append((r.event_id, r.first, r.last))
    for r in queries_folds.on_screen(spark, small).collect():
        by_user[r.user_id].append(r.asDict())
    for user, rows in by_user.items():
        assert sorted(got[user]) == slow(rows, 18.0)
        n += len(got[user])
    assert n > 5


def test_context_epochs_equal_slow_ones(spark, small):
    check(spark, small, "context_epochs", slow_epochs)


def test_overlap_repetitions_equal_slow_ones(spark, small):
    check(spark, small, "overlap_repetitions", slow_repetitions)


def test_dense_and_odd_rows(spark):
    rng = random.Random(11)
    texts = ["we go down to the mill", "the river runs all night", "oh night", "some say it never ran dry", "nobody knows how old it is", "we go down to the mills"]
    rows = []
    for k in range(600):
        text = rng.choice(texts)
        first = round(rng.uniform(0, 60), 1)
        rows.append({"u": k % 8, "id": k, "text": text, "first": first, "last": round(first + rng.uniform(0, 8 if text == "oh night" else 22), 1), "y": float(rng.choice([0, 15, 30, 60, 90])), "short": text == "oh night"})
    odd = [(0, 900, None, 1.0, 20.0, 0.0, False), (0, 901, texts[0], None, 20.0, 0.0, False), (0, 902, texts[0], 1.0, 20.0, None, False), (1, 903, "", 5.0, 5.1, 200.0, None)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows] + odd, "u long, id long, text string, first double, last double, y double, short boolean")
    by = defaultdict(list)
    for r in rows + [{"u": 1, "id": 903, "text": "", "first": 5.0, "last": 5.1, "y": 200.0, "short": False}]:
        by[r["u"]].append(r)
    for run, slow in ((lambda *a: sweeps.epochs(*a, few=9), lambda *a: slow_epochs(*a, few=9)), (sweeps.repetitions, slow_repetitions)):
        got, n = defaultdict(list), 0
        for r in run(df, ["u"], 18.0).collect():
            got[r.u].append((r.of, round(r.first, 4), round(r["last"], 4)))
        for u, own in by.items():
            assert sorted(got[u]) == slow(own, 18.0)
            n += len(got[u])
        assert n > 20
        assert run(df.limit(0), ["u"], 18.0).count() == 0


def slow_blocks(rows):
    """(id -> (block, place)): all of a block is looked at for each row."""
    blocks, now = [], []
    for r in sorted((r for r in rows if r["first"] is not None and r["last"] is not None and r["last"] > r["first"]), key=lambda r: (r["first"], r["last"], r["y"], r["id"])):
        brief = r["last"] - r["first"] <= 0.8
        starts = [x["first"] for x in now] + [r["first"]]
        shared = min(max((x["last"] for x in now), default=0), r["last"]) - max(min((x["first"] for x in now), default=0), r["first"])
        if now and (max(starts) - min(starts) > (1.8 if brief else 1.4) or shared < (0.15 if brief else 0.75) or len(now) >= 6):
            blocks.append(now)
            now = []
        now = [*now, r]
    blocks = [b for b in [*blocks, now] if len(b) > 1]
    return {r["id"]: (n, k) for n, b in enumerate(blocks) for k, r in enumerate(sorted(b, key=lambda r: (r["y"], r["first"], r["id"])))}


def slow_merges(rows):
    """Every row looks at all rows left, however long ago."""
    left = []
    for r in sorted(rows, key=lambda r: (r["first"], r["y"], r["id"])):
        for u in left:
            sim, dy, dt, gap = like(r["text"], u["text"]), abs(r["y"] - u["y"]), abs(r["first"] - u["first"]), max(0.0, r["first"] - u["last"])
            if not r["visible"] and u["visible"] and sim > 0.8 and dy < 30 and r["first"] >= u["last"] + 0.8:
                continue
            if (sim > 0.7 and dy < 30 or 0.6 <= sim <= 0.7 and dy < 40) if dt < 5 else gap < 5 and sim > 0.85 and dy < 30:
                a, b = r["last"] - r["first"], u["last"] - u["first"]
                size = lambda x: (len(x["text"].split()), sum(c.isalpha() for c in x["text"]))
                if a > b + 1 or not b > a + 1 and size(r) > size(u):
                    u["text"] = r["text"]
                u["last"], u["rows"] = max(u["last"], r["last"]), u["rows"] + 1
                break
        else:
            left.append(r | {"rows": 1})
    return sorted((u["id"], u["text"], round(u["first"], 4), round(u["last"], 4), u["rows"]) for u in left)


def crowd(rng):
    texts = ["we go down to the mill", "we go down to the mil", "we go dwn to the", "the river runs all night", "the rivr runs all nite", "oh night"]
    for k in range(500):
        first = round(rng.uniform(0, 70), 1)
        yield {"u": k % 6, "id": k, "text": rng.choice(texts), "first": first, "last": round(first + rng.choice([0.3, 0.7, 1, 2, 5, 9]), 1), "y": float(rng.choice([0, 15, 35, 60])), "visible": rng.random() < 0.5}


def test_blocks_and_merges_equal_slow_ones(spark, small):
    rows = [r.asDict() | {"u": r.user_id} for r in queries_folds.seen_rows(spark, small).collect()]
    blocks = {r.event_id: (r.block, r.row) for r in QUERIES["blocks_on_screen"](spark, small).collect()}
    merged = [(r.user_id, r.id, r.text, r.first, r["last"], r.rows) for r in QUERIES["merged_rows"](spark, small).collect()]
    made = list(crowd(random.Random(6)))
    df = spark.createDataFrame([tuple(r.values()) for r in made], "u long, id long, text string, first double, last double, y double, visible boolean")
    found = {r.id: (r.block, r.row) for r in sweeps.screen_blocks(df, ["u"], "first", "last", "y", "id").collect()}
    also = [(r.u, r.id, r.text, r.first, r["last"], r.rows) for r in sweeps.merged_repeats(df, ["u"]).collect()]
    for rows_, blocks_, merged_ in ((rows, blocks, merged), (made, found, also)):
        n = 0
        for u in {r["u"] for r in rows_}:
            own = [r for r in rows_ if r["u"] == u]
            want = slow_blocks(own)
            assert {r["id"]: blocks_[r["id"]] for r in own} == {r["id"]: want.get(r["id"], (None, None)) for r in own}
            assert sorted((m[1], m[2], round(m[3], 4), round(m[4], 4), m[5]) for m in merged_ if m[0] == u) == slow_merges(own)
            n += len(want)
        assert n > 20 and len(merged_) < len(rows_) - 20


def test_blocks_and_merges_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 1, None, 0.0, 1.0, 0.0, True), (1, 2, "a b", None, 1.0, 0.0, None), (1, 3, "a b", 2.0, 1.0, None, None), (1, 4, "a b", 2.0, 2.0, 0.0, None)], "u long, id long, text string, first double, last double, y double, visible boolean")
    assert sweeps.merged_repeats(df, ["u"]).count() == 4 and sweeps.merged_repeats(df.limit(0), ["u"]).count() == 0
    assert {(r.block, r.row) for r in sweeps.screen_blocks(df, ["u"], "first", "last", "y", "id").collect()} == {(None, None)}
