from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spanloom.operators import variants
from spanloom.plans import queries_folds
from spanloom.plans.registry import QUERIES


def slow_families(rows, apart=8.0):
    """(id, start, tokens): every pair of rows, in order of start."""
    up = {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    rows = sorted((r for r in rows if r[1] is not None and r[2] is not None and len(r[2]) >= 3), key=lambda r: (r[1], r[0]))
    linked = set()
    for i, (a, at, x) in enumerate(rows):
        up.setdefault(a, a)
        for b, later, y in rows[i + 1 :]:
            up.setdefault(b, b)
            if abs(len(x) - len(y)) <= 1 and later - at >= apart and len({*x} & {*y}) >= min(2, len({*x})) and SequenceMatcher(None, " ".join(x), " ".join(y)).ratio() >= 0.82:
                linked |= {a, b}
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {a: top(a) for a in linked}


def slow_canonical(rows):
    """(id, start, text, tokens, quality, sure) rows of a key: id -> (family, text)."""
    family = slow_families([(r[0], r[1], r[3]) for r in rows])
    out = {r[0]: (family.get(r[0]), r[2]) for r in rows}
    groups = defaultdict(list)
    for r in rows:
        if r[0] in family:
            groups[family[r[0]]].append(r)
    for group in groups.values():
        best = min(group, key=lambda r: (-r[4], -len(r[3]), r[0]))
        for r in group:
            fits = len(r[2].split()) == len(best[2].split()) == len(r[3]) and len(best[3]) >= 3 and best[4] - r[4] >= 0.18 and not r[5] and r[3] != best[3]
            if fits and SequenceMatcher(None, " ".join(r[3]), " ".join(best[3])).ratio() >= 0.86:
                out[r[0]] = (family[r[0]], best[2])
    return out


def test_canonical_lines_equal_slow_ones(spark, small):
    got = {r.event_id: (r.family, r.canonical) for r in QUERIES["canonical_lines"](spark, small).collect()}
    by_user, changed = defaultdict(list), 0
    for r in queries_folds.read_lines(spark, small).collect():
        by_user[r.user_id].append((r.event_id, r.start, r.text, r.tokens, r.quality, r.confidence > 0.6 and r.event_id % 5 != 0))
    for rows in by_user.values():
        for event, want in slow_canonical(rows).items():
            assert got[event] == want
        changed += sum(got[r[0]][1] != r[2] for r in rows)
    assert changed > 20 and sum(map(len, by_user.values())) == len(got)


def test_families_of_odd_rows(spark):
    texts = ["la la la", "la la la la", "la la li", "we go home now", "we go home", "we went home now", "go", "we go hom now", "a b c", "b c a"]
    rows = [(k % 2, k, float(3 * k % 40), t.split()) for k, t in enumerate(texts * 6)] + [(0, 90, None, ["we", "go", "home"]), (0, 91, 1.0, None), (None, 92, 0.0, ["we", "go", "home"]), (None, 93, 9.0, ["we", "go", "home"]), (0, 94, 5.0, [])]
    df = spark.createDataFrame(rows, "u int, id int, s double, t array<string>")
    got = {r.id: r.family for r in variants.joined_rows(variants.variant_links(df, ["u"], "id", "s", "t"), ["u"]).collect()}
    want = slow_families([(r[1], r[2], r[3]) for r in rows if r[0] == 0]) | slow_families([(r[1], r[2], r[3]) for r in rows if r[0] == 1])
    assert got == want and len(want) > 20
    assert variants.variant_links(df.limit(0), ["u"], "id", "s", "t").count() == 0


def test_families_are_the_same_whether_texts_are_held_or_joined(spark, small):
    """And where texts are held, hardly more links than rows are made."""
    lines = queries_folds.read_lines(spark, small).select("user_id", "event_id", "start", "tokens")
    links = [variants.variant_links(lines, ["user_id"], "event_id", "start", "tokens", most_texts=most) for most in (512, 0, 30)]
    one, two, three = ({r.id: r.family for r in variants.joined_rows(x, ["user_id"]).collect()} for x in links)
    assert one == two == three and one
    assert links[0].count() < 4 * lines.count() < links[1].count()


def test_read_quality(spark):
    got = spark.createDataFrame([(0.5, 0.25, 0.5), (None, None, None)], "a double, b double, c double").select(variants.read_quality(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [round(r[0], 9) for r in got] == [0.4, 0.4]


def test_texts_that_come_again_are_compared_once(monkeypatch):
    """Each key has the same lines: a pair of texts is matched once in a task, not once a key."""
    from spanloom.operators import align as al

    asked = []

    class Counted(al.SequenceMatcher):
        def ratio(self):
            asked.append(1)
            return super().ratio()

    monkeypatch.setattr(al, "SequenceMatcher", Counted)
    al.matching_ratio.cache_clear()
    ratios = [al.matching_ratio("we all go by night", "we al go by night") for _ in range(50)]
    assert len(asked) == 1 and len(set(ratios)) == 1
