from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import align as al
from spanloom.operators import tracking as tr


def test_block_numbers():
    assert tr.block_numbers([0.0, 0.5, 1.0, 3.0, 3.1], [5.0, 5.0, 1.5, 6.0, 6.0], 1.4, 0.75, 6) == [0, 0, 1, 2, 2]
    assert tr.block_numbers([0.0] * 5, [9.0] * 5, 1.0, 0.5, 2) == [0, 0, 1, 1, 2] and tr.block_numbers([], [], 1, 1, 1) == []


def test_shifts_carry_over():
    assert tr.shifts_by_silences([(0.0, 10.0), (20.0, 30.0), (50.0, 90.0)], [(0.0, 13.0), (20.0, 34.0)]) == [(10.0, 3.0), (30.0, 4.0)]
    assert tr.shift_lines([5.0, 10.0, 11.0, 30.0], [(10.0, 3.0), (30.0, -20.0)]) == [5.0, 13.0, 14.0, 14.0]


def test_cursor_never_goes_back():
    rng = random.Random(2)
    bags = [{f"w{k}", f"w{k + 1}"} for k in range(40)]
    lines = [{f"w{rng.randrange(45)}"} for _ in range(30)] + [set()]
    places = [p for p, _ in tr.cursor_assignments(lines, bags)]
    assert places == sorted(places) and tr.cursor_assignments([{"a"}], []) == [(-1, 0.0)]


def test_trimmed_rows_stay_in_order():
    rng = random.Random(4)
    starts = sorted(rng.uniform(0, 20) for _ in range(50))
    got = tr.trim_overlaps(starts, [s + rng.uniform(0, 2) for s in starts])
    assert all(b >= a + 0.06 - 1e-9 for a, b in got) and all(n[0] >= p[1] for p, n in zip(got, got[1:], strict=False))


def test_weaker_repeats(spark):
    rows = [(1, 0.0, "walk along the river", 0.9), (1, 3.0, "walk alone the river", 0.5), (1, 5.0, "walk along the river", 0.85), (1, 40.0, "walk along the river", 0.1), (2, 0.0, "too few", 0.1)]
    df = spark.createDataFrame(rows, "k int, at double, text string, q double")
    assert sorted((r.k, r.at) for r in tr.drop_weaker_repeats(df, ["k"], "at", "text", "q").collect()) == [(1, 0.0), (1, 5.0), (1, 40.0), (2, 0.0)]


def test_timed_warp(spark):
    a, b = ["so", "long", "marianne"], ["so", "lone", "marianne"]
    df = spark.createDataFrame([(a, [0.0, 1.0, 2.0], b, [0.5, 1.5, 2.5]), ([], [], b, [0.0, 1.0, 2.0]), (None, None, None, None)], "a array<string>, s array<double>, b array<string>, t array<double>")
    got = [r.x for r in df.select(al.timed_warp("a", "s", "b", "t").alias("x")).collect()]
    assert [(p.i, p.j) for p in got[0]] == [(0, 0), (1, 1), (2, 2)] and abs(got[0][0].cost - 0.3 * 0.5 / 20) < 1e-9 and got[1] == got[2] == []


def test_bands_and_costs():
    rng = np.random.default_rng(1)
    cost = rng.random((40, 44))
    exact, banded = al.warping_path(cost), al.warping_path(cost, 44)
    total = lambda p: sum(cost[i, j] for i, j in p)
    assert abs(total(exact) - total(banded)) < 1e-9 and total(al.warping_path(cost, 3)) >= total(exact) - 1e-9
    far = al.mixed_cost(["a"], np.array([0.0]), ["a"], np.array([50.0]))
    assert far[0, 0] == 1.0
    assert al.assignments([(0, 0), (0, 1), (1, 1)], np.array([[0.5, 0.2], [1.0, 0.1]])) == [(0, 1, 0.2), (1, 1, 0.1)]


def test_syllables():
    assert al.syllable_groups(list("banana")) == [["b", "a"], ["n", "a"], ["n", "a"]] and al.syllable_groups(list("ast")) == [["a"], ["s", "t"]] and al.syllable_groups([]) == []


def test_syllables_of_a_column_equal_the_groups(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abeoyrstn") for _ in range(rng.randrange(1, 9))) for _ in range(50)]
    rows = spark.createDataFrame([(w,) for w in words] + [("A-b é",), ("",), (None,)], "w string").select("w", tx.syllables(F.col("w")).alias("p")).collect()
    got = {r.w: r.p for r in rows}
    assert all(got[w] == ["".join(g) for g in al.syllable_groups(list(w))] for w in words)
    assert got["A-b é"] == ["a", "b"] and got[""] == [] and got[None] is None
