"""Hand-computed cases for each branch of the policies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.functions import policies as po


def frame(spark, rows: list[dict]):
    names = sorted({k for r in rows for k in r})
    kinds = {k: "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "double" for r in rows for k, v in r.items() if v is not None}
    data = [tuple(None if r.get(k) is None else r[k] if kinds[k] != "double" else float(r[k]) for k in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{k} {kinds.get(k, 'double')}" for k in names))


def test_trust(spark):
    cases = [
        (11.9, True, True, True, "degraded_duration_mismatch", "duration_mismatch_not_severe"),
        (12.0, True, True, True, "degraded_outro_padding", "likely_trailing_outro_padding"),
        (30.0, True, False, False, "dropped_duration_mismatch", "severe_mismatch_with_audio_recovery"),
        (30.0, False, False, True, "degraded_duration_mismatch", "severe_mismatch_without_audio_recovery"),
    ]
    got = po.trust_policy(frame(spark, [{"n": k, "mismatch": m, "recoverable": r, "padding": p} for k, (m, r, p, *_) in enumerate(cases)])).orderBy("n").collect()
    assert [(r["keep"], r["mode"], r["reason"]) for r in got] == [c[3:] for c in cases]


@pytest.mark.parametrize(
    ("change", "retry"),
    [({}, True), ({"line_count": 24}, False), ({"tried": True}, False), ({"matched_ratio": 0.77}, False), ({"matched_ratio": 0.89}, False), ({"line_coverage": 0.79}, False), ({"line_coverage": 0.93}, False), ({"phonetic_similarity_coverage": 0.34}, False), ({"matched_ratio": None}, False)],
)
def test_retry(spark, change, retry):
    row = {"line_count": 25, "tried": False, "matched_ratio": 0.8, "line_coverage": 0.9, "phonetic_similarity_coverage": 0.35, "x": 1.0} | change
    df = frame(spark, [row | {"matched_ratio": 0.8}]).withColumn("matched_ratio", F.lit(row["matched_ratio"]).cast("double"))
    assert po.should_retry(df).first()["retry"] is retry


def test_offsets(spark):
    no, yes = False, True
    cases = [  # delta, given, alternate, large negative, allow positive, suppress negative: applied
        (0.3, None, no, no, no, no, 0.0), (0.5, None, no, no, no, no, 0.5), (0.5, None, yes, no, no, no, 0.3), (1.0, None, no, no, no, no, 0.5), (-1.0, None, yes, no, no, no, -0.3), (2.5, None, no, no, no, no, 2.5), (2.6, None, no, no, no, no, 0.0),
        (2.6, None, no, no, yes, no, 2.6), (4.0, None, yes, no, yes, no, 2.4), (-4.0, None, no, no, yes, no, 0.0), (5.1, None, no, no, yes, no, 0.0), (-2.0, None, no, yes, no, no, -1.0), (2.0, None, no, yes, no, no, 2.0), (-1.3, None, no, no, no, yes, 0.0),
        (-2.0, None, no, no, no, yes, -2.0), (-2.0, None, no, yes, no, yes, 0.0), (7.0, 0.25, no, no, no, no, 0.25),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "n int, delta double, given double, alternate boolean, large boolean, positive boolean, negative boolean, want double")
    got = df.select("n", "want", po.auto_offset(F.col("delta"), F.col("given"), F.col("alternate"), 0.5, (0.8, 1.6), F.col("large"), F.col("positive"), F.col("negative")).alias("got")).collect()
    assert {r["n"]: r["got"] for r in got} == pytest.approx({r["n"]: r["want"] for r in got})


def test_timing_quality(spark):
    none = dict.fromkeys(po.TIMING_METRICS)
    rows = [
        none | {"dtw_line_coverage": 1.0, "dtw_word_coverage": 1.0},  # 0.42 + 0.26 + 0.22 + 0.1 * (0.35 + 0.2)
        none | {"dtw_line_coverage": 1.0, "low_confidence_ratio": 0.125, "whisper_anchor_start_p95_abs_sec": 1.0},  # 0.7 / 2 + 0.3 / 2
        none | {"dtw_line_coverage": 0.5, "dtw_word_coverage": 0.5, "gold_comparable_word_count": 20, "gold_word_coverage_ratio": 1.0},  # internal 0.615, gold 1
        none | {"dtw_line_coverage": 1.0, "dtw_word_coverage": 1.0, "gold_comparable_word_count": 8, "gold_word_count": 40, "gold_word_coverage_ratio": 0.8, "gold_start_mean_abs_sec": 1.25},
        none | {"dtw_line_coverage": 1.0, "dtw_word_coverage": 1.0, "gold_comparable_word_count": 8, "gold_word_count": 41, "gold_word_coverage_ratio": 0.8, "gold_start_mean_abs_sec": 1.25},
    ]
    got = po.timing_quality(frame(spark, [r | {"n": k} for k, r in enumerate(rows)])).orderBy("n").collect()
    assert [r["timing_quality_score"] for r in got] == pytest.approx([0.955, 0.5, 0.6997, 0.28, 0.955])
    assert [(r["timing_quality_band"], r["timing_quality_mode"]) for r in got] == [("excellent", "dtw_internal"), ("fair", "anchor_fallback"), ("good", "dtw_internal+gold"), ("poor", "dtw_internal+gold_clip"), ("excellent", "dtw_internal")]


def test_quality_scores(spark):
    rows = [(0.9, 2.5, True, 30, 0, 100.0), (0.7, 1.7, True, 30, 0, 75.0), (0.5, 1.0, False, 9, 3, 5.0), (0.9, 2.5, True, 1, 0, 20.0), (0.9, 2.5, True, 0, 0, 0.0)]
    got = po.lyric_quality(spark.createDataFrame(rows, "coverage double, density double, duration_match boolean, n_lines int, large_gaps int, want double")).collect()
    assert [r["quality"] for r in got] == [r["want"] for r in got]
    one = spark.range(1).select(
        po.alignment_score(F.lit(50.0), F.lit("whisper_hybrid"), F.lit(2)).alias("a"), po.alignment_score(F.lit(50.0), F.lit("none"), F.lit(2)).alias("b"), po.alignment_score(F.lit(98.0), F.lit("onset_refined"), F.lit(0)).alias("c"), po.alignment_score(F.lit(30.0), F.lit("what"), F.lit(0)).alias("d"),
        po.dtw_score({}).alias("e"), po.dtw_score({"matched_ratio": F.lit(0.5), "avg_similarity": F.lit(0.8)}).alias("f"), po.dtw_score({k: F.lit(1.0) for k in po.DTW_POINTS}).alias("g"),
    ).first()
    assert tuple(one) == pytest.approx((50.0, 0.0, 100.0, 30.0, 40.0, 40 + 10 + 12 + 4 + 2.4, 100.0))


BASE = {"agreement_coverage_ratio": 0.5, "agreement_start_p95_abs_sec": 0.5, "agreement_eligibility_ratio": 0.7, "agreement_match_ratio_within_eligible": 0.8, "dtw_line_coverage": 0.8}
KNOWN = [
    "agreement_coverage_ratio", "agreement_start_p95_abs_sec", "agreement_eligibility_ratio", "agreement_match_ratio_within_eligible", "dtw_line_coverage", "low_confidence_ratio", "gold_word_coverage_ratio", "gold_start_mean_abs_sec", "gold_pre_whisper_start_mean_abs_sec",
    "gold_downstream_regression_line_count", "gold_downstream_regression_mean_improvement_sec", "hook_boundary_variant_ratio", "truncation_pattern_ratio", "repetitive_phrase_line_ratio", "low_text_similarity", "low_token_overlap", "anchor_outside_window",
]


@pytest.mark.parametrize(
    ("row", "failure"),
    [
        ({k: None for k in BASE} | {"anchor_outside_window": 9}, "mixed_or_unclear"),
        ({"hint": "review_dtw_lexical_matching", "gold_word_coverage_ratio": 0.8, "hook_boundary_variant_ratio": 0.25}, "lexical_hook_boundary_variants"),
        ({"hint": "review_dtw_lexical_matching", "gold_word_coverage_ratio": 0.8, "repetitive_phrase_line_ratio": 0.02}, "lexical_hook_variant_matching"),
        ({"anchor_outside_window": 1, "timing_delta_clamped": True, "agreement_match_ratio_within_eligible": 0.7}, "repetition_handling"),
        ({"gold_downstream_regression_line_count": 6, "gold_downstream_regression_mean_improvement_sec": 0.6, "gold_start_mean_abs_sec": 0.5}, "downstream_timing_regression"),
        ({"agreement_start_p95_abs_sec": 1.1}, "timing_drift"),
        ({"agreement_coverage_ratio": 0.2}, "sparse_lexical_comparability"),
        ({"low_text_similarity": 1, "low_token_overlap": 1}, "sparse_lexical_comparability"),
        ({"agreement_start_p95_abs_sec": 0.95}, "timing_drift"),
        ({}, "mixed_or_unclear"),
    ],
)
def test_failures(spark, row, failure):
    made = {k: None for k in KNOWN} | {"hint": None, "timing_delta_clamped": False} | BASE | row
    df = spark.range(1).select(*(F.lit(v).cast("string" if k == "hint" else "boolean" if k == "timing_delta_clamped" else "double").alias(k) for k, v in made.items()))
    assert po.failure_mode(df).first()["failure"] == failure


def test_triage_steps(spark):
    good = dict.fromkeys(po.TRIAGE_METRICS, 0.0) | {"dtw_line_coverage": 0.8, "dtw_word_coverage": 0.7, "suspected": False, "gold_available": True, "timing_quality_score": None}
    rows = [good, good | {"dtw_line_coverage": 0.25}, good | {"dtw_line_coverage": 0.25, "suspected": True}, good | {"dtw_word_coverage": 0.2, "timing_quality_score": 0.8}, good | {"agreement_start_p95_abs_sec": 2.0, "agreement_coverage_ratio": 0.25, "timing_quality_score": 0.5}, good | {"low_confidence_ratio": 0.9}]
    df = frame(spark, [r | {"n": k} for k, r in enumerate(rows)])
    got = {int(r["n"]): (r["triage_score"], r["reasons"]) for r in po.triage(df, po.PIPELINE_STEPS, 0.25).collect()}
    assert got == {
        1: (1.0, ["low_dtw_line_coverage"]), 3: (0.4, ["low_dtw_word_coverage", "timing_quality_score_good"]), 4: (0.35, ["high_agreement_p95", "low_timing_quality_score"]), 5: (0.5, ["high_low_confidence_ratio"]),
    }
    ref = [good | {"suspected": True, "divergence_score": 9.0}, good | {"gold_available": False, "dtw_line_coverage": 0.5, "dtw_word_coverage": 0.4, "agreement_coverage_ratio": 0.1, "agreement_text_similarity_mean": 0.9}, good]
    got = {int(r["n"]): r["triage_score"] for r in po.triage(frame(spark, [r | {"n": k} for k, r in enumerate(ref)]), po.REFERENCE_STEPS, 0.0).collect()}
    assert got == {0: 4.0, 1: 1.0}
    assert po.triage_rankings(df, "n", 2).where("kind = 'likely_pipeline_failure'").orderBy("place").select("n").collect()[0][0] == 1


def test_override_gain(spark):
    got = spark.createDataFrame([(2.0, 0.5, 0.1, False), (2.0, 0.5, 0.1, True), (2.0, None, 3.0, True), (None, 1.0, None, False), (2.0, 0.0, 0.0, True)], "a double, b double, c double, d boolean")
    assert [r[0] for r in got.select(po.override_gain(*(F.col(c) for c in "abcd"))).collect()] == pytest.approx([1.5, 1.9, 0.0, -1.0, 0.0])


GOOD = {"line_count": 30, "dtw_line_coverage": 0.9, "dtw_word_coverage": 0.6, "low_confidence_ratio": 0.1, "agreement_coverage_ratio": 0.5, "agreement_start_p95_abs_sec": 0.9}
GOLD = {"gold_comparable_word_count": 40, "gold_word_coverage_ratio": 0.8, "gold_start_mean_abs_sec": 0.65, "gold_start_p95_abs_sec": 1.9}
REVIEW = "review_dtw_lexical_matching"


@pytest.mark.parametrize(
    ("metrics", "flags", "verdict"),
    [
        (GOOD, {"suspected": True}, ("likely_reference_divergence", "medium", ["reference_divergence_suspected"])),
        (GOOD, {"suspected": True, "divergence_confidence": "high", "divergence_evidence": ["b", "a"]}, ("likely_reference_divergence", "high", ["a", "b"])),
        (GOOD | {"line_count": 7}, {"hint": "x"}, ("insufficient_evidence", "low", ["insufficient_coverage"])),
        ({"line_count": 9}, {}, ("insufficient_evidence", "low", ["insufficient_coverage"])),
        (GOOD, {"hint": "x"}, ("likely_pipeline_ok", "medium", ["policy_hint:x", "strong_internal_alignment"])),
        (GOOD | GOLD, {"gold_available": True}, ("likely_pipeline_ok", "high", ["gold_timing_consistent", "strong_internal_alignment"])),
        (
            GOOD | GOLD | {"dtw_word_coverage": 0.5, "hook_boundary_variant_ratio": 0.25, "agreement_hook_boundary_eligibility_ratio": 0.9, "agreement_hook_boundary_text_similarity_mean": 0.9}, {"gold_available": True, "hint": REVIEW},
            ("needs_manual_review", "medium", ["agreement_consistent", "gold_timing_consistent", "hook_boundary_variants_dominant", "hook_normalized_agreement_consistent", f"policy_hint:{REVIEW}", REVIEW]),
        ),
        (
            GOOD | {"gold_downstream_regression_line_count": 6, "gold_downstream_regression_mean_improvement_sec": 0.6, "gold_start_mean_abs_sec": 1.0}, {"gold_available": True, "hint": "none"},
            ("needs_pipeline_work", "high", ["downstream_regression_dominant", "pre_whisper_timing_stronger_than_final"]),
        ),
        (GOOD | {"dtw_line_coverage": 0.7, "dtw_word_coverage": 0.4, "low_confidence_ratio": 0.3, "agreement_start_p95_abs_sec": 1.3}, {}, ("needs_pipeline_work", "high", ["high_agreement_p95", "high_low_confidence_ratio", "low_dtw_line_coverage", "low_dtw_word_coverage"])),
        (GOOD | {"dtw_word_coverage": 0.5}, {}, ("needs_manual_review", "medium", ["mixed_signals"])),
    ],
)
def test_verdicts(spark, metrics, flags, verdict):
    made = dict.fromkeys(po.VERDICT_METRICS) | metrics
    said = {"gold_available": False, "suspected": False, "divergence_confidence": None, "hint": None} | {k: v for k, v in flags.items() if k != "divergence_evidence"}
    evidence = flags.get("divergence_evidence")
    df = spark.range(1).select(
        *(F.lit(v).cast("double").alias(k) for k, v in made.items()), *(F.lit(v).cast("boolean" if k in ("gold_available", "suspected") else "string").alias(k) for k, v in said.items()),
        (F.array(*map(F.lit, evidence)) if evidence else F.lit(None).cast("array<string>")).alias("divergence_evidence"),
    )
    r = po.quality_verdict(df).first()
    assert (r["verdict"], r["confidence"], r["reasons"]) == verdict


def test_line_eligibility(spark):
    base = {"n_words": 5.0, "window_words": 5.0, "window_prob": 0.9, "start": 10.0, "anchor_start": 10.2, "window_start": 9.0, "window_end": 12.0, "similarity": 0.9, "overlap": 0.9, "leads": True}
    cases = [
        ({}, None, True, False), ({"n_words": 6.0, "window_words": 1.0}, "insufficient_window_words_for_long_line", False, False), ({"window_words": 1.0, "window_prob": 0.4}, "low_window_confidence_and_sparse_words", False, False),
        ({"n_words": 4.0, "window_words": 1.0}, "explicit_window_too_sparse", False, False), ({"n_words": 4.0, "window_words": None}, None, True, False), ({"start": None}, "missing_line_start", False, False), ({"anchor_start": None}, "missing_anchor_start", False, False),
        ({"anchor_start": 7.9}, "anchor_outside_window", False, False), ({"anchor_start": 13.1}, "anchor_outside_window", False, False), ({"window_end": None, "anchor_start": 99.0}, None, True, False), ({"anchor_start": 10.8, "leads": False}, "missing_window_line_start", True, False),
        ({"anchor_start": 10.8, "leads": None}, None, True, False), ({"similarity": 0.1, "anchor_start": 10.5}, "low_text_similarity", True, False), ({"overlap": 0.1, "anchor_start": 10.5}, "low_token_overlap", True, False), ({"similarity": 0.1}, None, True, True),
        ({"similarity": 0.1, "n_words": 3.0, "anchor_start": 10.1}, None, True, True), ({"similarity": 0.1, "overlap": 0.2, "window_words": 2.0}, None, True, True), ({"similarity": 0.1, "overlap": 0.2, "window_prob": None}, "low_text_similarity", True, False),
    ]
    rows = [tuple((base | c[0])[k] for k in po.LINE_COLUMNS) + (n,) for n, c in enumerate(cases)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'boolean' if c == 'leads' else 'double'}" for c in po.LINE_COLUMNS) + ", n int")
    got = {r["n"]: (r["skip_reason"], r["eligible"], r["rescued"]) for r in po.line_eligibility(df, 0.58, 0.5).collect()}
    assert got == {n: c[1:] for n, c in enumerate(cases)}


def test_line_eligibility_at_the_least_overlap(spark):
    """0.5 - 0.35 is 0.15000000000000002 in doubles; an overlap of 0.15 is enough all the same."""
    row = {"n_words": 5.0, "window_words": 5.0, "window_prob": 0.9, "start": 10.0, "anchor_start": 10.1, "window_start": 9.0, "window_end": 12.0, "similarity": 0.1, "overlap": 0.15, "leads": True}
    df = spark.createDataFrame([tuple(row[k] for k in po.LINE_COLUMNS)], ", ".join(f"{c} {'boolean' if c == 'leads' else 'double'}" for c in po.LINE_COLUMNS))
    r = po.line_eligibility(df, 0.58, 0.5).first()
    assert (r["skip_reason"], r["eligible"], r["rescued"]) == (None, True, True)


def test_policy_rules_hold_users_of_one_event(spark, tmp_path):
    from spanloom.plans.registry import ORACLES, QUERIES

    from .oracle import by_sql, normal

    df = spark.sql("SELECT CAST(id AS bigint) AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, CAST(id DIV 3 AS bigint) AS user_id, 'view' AS event_type, CAST(id * 20 AS double) AS value, '{}' AS props FROM range(4)")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.quality for r in QUERIES["policy_rules"](spark, str(tmp_path)).collect()}
    assert got.keys() == {0, 1} and got[1] == 20.0
    assert normal(QUERIES["policy_rules"](spark, str(tmp_path)).toPandas()) == normal(by_sql(ORACLES["policy_rules"], str(tmp_path)))


def test_policy_rules_hold_scores_trust_and_failures(spark, tmp_path):
    """Users 0 to 5 with 1 to 6 events; user 6 has no values, and one user is null."""
    from spanloom.plans.registry import ORACLES, QUERIES

    from .oracle import by_sql, normal

    rows = [(u * 10 + k, u, "signup" if u == 4 and k == 0 else "view", float(u * 17 % 100 + (k % 2) * 30)) for u in range(6) for k in range(u + 1)]
    rows += [(100, 6, "view", None), (101, 6, "view", None), (102, None, "view", 95.0), (103, None, "view", 5.0)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").selectExpr("event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "user_id", "event_type", "value", "'{}' AS props")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["policy_rules"](spark, str(tmp_path))
    assert out.columns == ["user_id", "quality", "reason", "retry", "score", "mode", "trust", "failure"]
    got = {r.user_id: (r.score, r["mode"], r.trust, r.failure) for r in out.collect()}
    assert got[0] == (0.0, "internal", "reject", "coverage") and got[1] == (0.29, "blended", "reject", "offset") and got[4][2] == "trust_start" and len(got) == 8
    assert normal(out.toPandas()) == normal(by_sql(ORACLES["policy_rules"], str(tmp_path)))
