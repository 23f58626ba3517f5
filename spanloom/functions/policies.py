"""Policies, quality scores and triage of a record's metrics, as tables of rules.

As in ``diagnosis``, rules are data: SQL predicates and amounts over a DataFrame's columns, which a caller may replace.
The tables' numbers, names and labels are those of the reports that these operators read and write.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diagnosis import Cases, first_case, with_terms
from .scoring import QUALITY, band, clamp

Steps = Iterable[tuple[str, str, tuple[str, ...]]]

#: Bonus of an alignment's method, and points that an issue costs.
METHODS = {"whisper_hybrid": 10, "onset_refined": 5, "lrc_only": 0, "genius_fallback": -20, "none": -50}
ISSUE = 5
#: Points of an alignment's metrics, on top of 40; the sum lies in 20 to 100.
DTW_POINTS = {"matched_ratio": 20.0, "avg_similarity": 15.0, "line_coverage": 10.0, "phonetic_similarity_coverage": 10.0, "high_similarity_ratio": 3.0, "exact_match_ratio": 2.0}
#: What timed lyrics lose of 100 points, by the first that holds of each group.
LYRIC_LOSSES = (
    (("coverage < 0.6", 30), ("coverage < 0.8", 15)),
    (("density < 1.5", 20), ("density < 2.0", 10)),
    (("NOT duration_match", 20),),
    (("n_lines < 10", 15),),
    (("large_gaps > 2", 10),),
)
#: What a report's metrics may be worth, 0 to 1 each, in the parts of a timing score.
AGREEMENT = (("agreement_coverage_ratio / 0.5", 0.45), ("1 - agreement_start_p95_abs_sec / 1.5", 0.35), ("1 - agreement_bad_ratio / 0.25", 0.2))
INTERNAL = (("dtw_line_coverage", 0.42), ("dtw_word_coverage", 0.26), ("1 - low_confidence_ratio / 0.25", 0.22), ("agreement", 0.1))
FALLBACK = (("1 - whisper_anchor_start_p95_abs_sec / 2.0", 0.7), ("1 - low_confidence_ratio / 0.25", 0.3))
GOLD = (("gold_word_coverage_ratio", 0.35), ("1 - gold_start_mean_abs_sec / 1.25", 0.65))
GOLD_SHARE = 0.22
TIMING_METRICS = (
    "dtw_line_coverage", "dtw_word_coverage", "low_confidence_ratio", "agreement_coverage_ratio", "agreement_start_p95_abs_sec", "agreement_bad_ratio", "whisper_anchor_start_p95_abs_sec",
    "gold_word_coverage_ratio", "gold_start_mean_abs_sec", "gold_comparable_word_count", "gold_word_count",
)
#: Cases of how far given line times are trusted: label, predicate; then whether they stay, and why.
TRUST = (
    ("duration_mismatch_not_severe", "mismatch < {severe}"),
    ("likely_trailing_outro_padding", "padding"),
    ("severe_mismatch_with_audio_recovery", "recoverable"),
)
TRUST_MODES = {
    "duration_mismatch_not_severe": "degraded_duration_mismatch", "likely_trailing_outro_padding": "degraded_outro_padding", "severe_mismatch_with_audio_recovery": "dropped_duration_mismatch",
    "severe_mismatch_without_audio_recovery": "degraded_duration_mismatch",
}
#: When a second, aggressive pass is worth trying.
RETRY = "NOT tried AND line_count >= 25 AND matched_ratio BETWEEN 0.78 AND 0.88 AND line_coverage BETWEEN 0.80 AND 0.92 AND phonetic_similarity_coverage >= 0.35"
#: Terms of the dominant failure of an alignment.
FAILURE_TERMS = {
    "unknown": "agreement_coverage_ratio IS NULL AND agreement_start_p95_abs_sec IS NULL AND agreement_eligibility_ratio IS NULL AND agreement_match_ratio_within_eligible IS NULL AND dtw_line_coverage IS NULL",
    "lexical_review": "hint = 'review_dtw_lexical_matching' AND coalesce(gold_word_coverage_ratio, 0) >= 0.75 AND coalesce(gold_start_mean_abs_sec, 0) <= 0.5 AND coalesce(agreement_coverage_ratio, 0) >= 0.4 AND coalesce(agreement_start_p95_abs_sec, 0) <= 0.9 AND coalesce(low_confidence_ratio, 0) <= 0.1 AND (coalesce(hook_boundary_variant_ratio, 0) >= 0.12 OR coalesce(truncation_pattern_ratio, 0) >= 0.15 OR coalesce(repetitive_phrase_line_ratio, 0) >= 0.02)",
    "hooks": "coalesce(hook_boundary_variant_ratio, 0) >= 0.25",
    "repetition": "coalesce(anchor_outside_window, 0) + CASE WHEN timing_delta_clamped THEN 2 ELSE 0 END >= 3 AND coalesce(low_text_similarity, 0) + coalesce(low_token_overlap, 0) <= 1 AND coalesce(agreement_match_ratio_within_eligible, 0) < 0.75",
    "regression": "coalesce(gold_downstream_regression_line_count, 0) >= 6 AND coalesce(gold_downstream_regression_mean_improvement_sec, 0) >= 0.6 AND coalesce(gold_pre_whisper_start_mean_abs_sec, 0) + 0.15 < coalesce(gold_start_mean_abs_sec, 0)",
    "strong_drift": "coalesce(dtw_line_coverage, 0) >= 0.7 AND coalesce(agreement_start_p95_abs_sec, 0) >= 1.1 AND coalesce(agreement_eligibility_ratio, 0) >= 0.6 AND coalesce(agreement_match_ratio_within_eligible, 0) >= 0.45",
    "sparse": "coalesce(agreement_coverage_ratio, 0) < 0.25 OR coalesce(agreement_eligibility_ratio, 0) < 0.35 OR coalesce(low_text_similarity, 0) + coalesce(low_token_overlap, 0) >= 2",
    "drift": "coalesce(dtw_line_coverage, 0) >= 0.6 AND coalesce(agreement_start_p95_abs_sec, 0) > 0.9",
}
#: Failures in order of precedence.
FAILURES = (
    ("mixed_or_unclear", "unknown"),
    ("lexical_hook_boundary_variants", "lexical_review AND hooks"),
    ("lexical_hook_variant_matching", "lexical_review"),
    ("repetition_handling", "repetition"),
    ("downstream_timing_regression", "regression"),
    ("timing_drift", "strong_drift"),
    ("sparse_lexical_comparability", "sparse"),
    ("timing_drift", "drift"),
)
#: Steps of the score for a wrong reference: predicate, points, reasons.
REFERENCE_STEPS = (
    ("suspected", "2.0 + least(divergence_score, 4.0) / 2", ("reference_divergence_suspected",)),
    (
        "NOT gold_available AND dtw_line_coverage <= 0.6 AND dtw_word_coverage <= 0.45 AND agreement_coverage_ratio >= 0.07 AND agreement_text_similarity_mean >= 0.9 AND agreement_start_p95_abs_sec <= 1.2 AND low_confidence_ratio <= 0.08",
        "1.0",
        ("low_dtw_with_strong_anchor_agreement",),
    ),
)
#: Steps of the score for a failed pipeline, in order; the sum never falls below 0.
PIPELINE_STEPS = (
    ("dtw_line_coverage < 0.75", "(0.75 - dtw_line_coverage) * 2.0", ("low_dtw_line_coverage",)),
    ("dtw_word_coverage < 0.6", "(0.6 - dtw_word_coverage) * 1.5", ("low_dtw_word_coverage",)),
    ("low_confidence_ratio > 0.1", "least(low_confidence_ratio, 0.5)", ("high_low_confidence_ratio",)),
    ("agreement_start_p95_abs_sec > 1.0", "least((agreement_start_p95_abs_sec - 1.0) / 2.0, 1.5) * greatest(0.3, least(1.0, agreement_coverage_ratio / 0.5))", ("high_agreement_p95",)),
    ("agreement_bad_ratio > 0.1", "(agreement_bad_ratio - 0.1) * 2.0 * greatest(0.3, least(1.0, agreement_coverage_ratio / 0.5))", ("high_agreement_bad_ratio",)),
    ("known_quality < 0.55", "least((0.55 - known_quality) * 2.0, 0.8)", ("low_timing_quality_score",)),
    ("known_quality >= 0.78", "-0.2", ("timing_quality_score_good",)),
    (
        "hook_boundary_variant_ratio >= 0.25 AND agreement_hook_boundary_eligibility_ratio >= greatest(0.85, agreement_coverage_ratio + 0.2) AND agreement_hook_boundary_text_similarity_mean >= 0.9 AND agreement_start_p95_abs_sec <= 0.9 AND low_confidence_ratio <= 0.1",
        "-0.45",
        ("hook_boundary_variants_dominant", "hook_normalized_agreement_consistent"),
    ),
    ("suspected", "-1.0", ("downgraded_due_to_reference_divergence",)),
    (
        "dtw_line_coverage >= 0.95 AND dtw_word_coverage >= 0.95 AND low_confidence_ratio <= 0.05 AND agreement_coverage_ratio >= 0.9 AND gold_word_coverage_ratio >= 0.95 AND gold_start_mean_abs_sec <= 0.25 AND gold_start_p95_abs_sec <= 0.5 AND known_quality >= 0.9",
        "-0.9",
        ("gold_timing_consistent_despite_anchor_disagreement",),
    ),
)
TRIAGE_METRICS = (
    "dtw_line_coverage", "dtw_word_coverage", "low_confidence_ratio", "agreement_coverage_ratio", "agreement_text_similarity_mean", "agreement_start_p95_abs_sec", "agreement_bad_ratio", "gold_word_coverage_ratio", "gold_start_mean_abs_sec",
    "gold_start_p95_abs_sec", "hook_boundary_variant_ratio", "agreement_hook_boundary_eligibility_ratio", "agreement_hook_boundary_text_similarity_mean", "divergence_score",
)


def worth(parts: Iterable[tuple[str, float]]) -> Column:
    """The weighted sum of the parts, each held between 0 and 1."""
    return sum((clamp(F.expr(p)) * w for p, w in parts), F.lit(0.0))


def alignment_score(base: Column, method: Column, issues: Column, methods: Mapping[str, int] = METHODS, issue: int = ISSUE) -> Column:
    """A base score with the method's bonus, less points for each issue; 0 to 100. Unknown methods have no bonus."""
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in methods.items() for x in kv]), method), F.lit(0))
    return clamp(base + bonus - issues * issue, 0.0, 100.0)


def dtw_score(metrics: Mapping[str, Column], points: Mapping[str, float] = DTW_POINTS) -> Column:
    """40 points and those of each metric, 20 to 100. A missing phonetic coverage is the matched ratio times the similarity,
    a missing share of high similarities the similarity; others count 0."""
    get = lambda k, other=None: F.coalesce(metrics[k], F.lit(0.0) if other is None else other) if k in metrics else F.lit(0.0) if other is None else other
    matched, like = get("matched_ratio"), get("avg_similarity")
    known = {k: get(k) for k in points} | {"phonetic_similarity_coverage": get("phonetic_similarity_coverage", matched * like), "high_similarity_ratio": get("high_similarity_ratio", like)}
    return clamp(sum((known[k] * n for k, n in points.items()), F.lit(40.0)), 20.0, 100.0)


def lyric_quality(df: DataFrame, losses=LYRIC_LOSSES) -> DataFrame:
    """df (coverage, density of lines in ten seconds, duration_match, n_lines, large_gaps) with ``quality``: 100 points less
    losses. Fewer than two lines are worth 20, none 0."""
    lost = sum((F.coalesce(*[F.when(F.expr(p), F.lit(n)) for p, n in group], F.lit(0)) for group in losses), F.lit(0))
    return df.withColumn("quality", F.when(F.col("n_lines") < 1, 0.0).when(F.col("n_lines") < 2, 20.0).otherwise(clamp((100 - lost).cast("double"), 0.0, 100.0)))


def timing_quality(df: DataFrame, digits: int = 4) -> DataFrame:
    """df (TIMING_METRICS) with timing_quality_score (to so many digits), timing_quality_band and timing_quality_mode.

    Internal metrics where both coverages are known, else a fallback on anchors; blended with the gold metrics where 20
    words compare, held down by them where a short gold text compares well. Other nulls count 0.
    """
    own = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in TIMING_METRICS}
    dtw = F.col("dtw_line_coverage").isNotNull() & F.col("dtw_word_coverage").isNotNull()
    known = df.select(*(F.col(c).alias(f"__{c}") for c in df.columns), dtw.alias("__dtw"), *(v.alias(c) for c, v in own.items()))
    known = known.withColumn("agreement", worth(AGREEMENT)).withColumns({"__own": F.when(F.col("__dtw"), worth(INTERNAL)).otherwise(worth(FALLBACK)), "__gold": worth(GOLD)})
    blended = F.col("gold_comparable_word_count") >= 20
    clipped = ~blended & F.expr("gold_word_count <= 40 AND gold_comparable_word_count >= 8 AND gold_word_coverage_ratio >= 0.75")
    score = clamp(F.when(blended, (1 - GOLD_SHARE) * F.col("__own") + GOLD_SHARE * F.col("__gold")).when(clipped, F.least("__own", "__gold")).otherwise(F.col("__own")))
    mode = F.concat(F.when(F.col("__dtw"), "dtw_internal").otherwise("anchor_fallback"), F.when(blended, "+gold").when(clipped, "+gold_clip").otherwise(""))
    out = known.withColumns({"__score": score, "__mode": mode})
    return out.select(*(F.col(f"__{c}").alias(c) for c in df.columns), F.round("__score", digits).alias("timing_quality_score"), band(F.col("__score"), QUALITY, "poor").alias("timing_quality_band"), F.col("__mode").alias("timing_quality_mode"))


def trust_policy(df: DataFrame, severe: float = 12.0, cases: Cases = TRUST, modes: Mapping[str, str] = TRUST_MODES) -> DataFrame:
    """df (mismatch in seconds, recoverable, padding) with keep, mode and reason: given line times go only where the duration
    is far off and the audio can make up for them."""
    reason = first_case([(label, p.format(severe=severe)) for label, p in cases], "severe_mismatch_without_audio_recovery")
    named = F.create_map(*[F.lit(x) for kv in modes.items() for x in kv])
    out = df.withColumn("reason", reason)
    return out.withColumns({"keep": F.col("reason") != "severe_mismatch_with_audio_recovery", "mode": F.element_at(named, F.col("reason"))})


def should_retry(df: DataFrame, rule: str = RETRY) -> DataFrame:
    """df (line_count, tried and the alignment's metrics) with ``retry``; unknown metrics are no reason to."""
    return df.withColumn("retry", F.coalesce(F.expr(rule), F.lit(False)))


def auto_offset(delta: Column, given: Column, alternate: Column, scale: Column | float, scaled: tuple[float, float], large_negative: Column, allow_positive: Column, suppress_negative: Column, dead: float = 0.3, plain: float = 2.5, most: float = 5.0, moderate: float = 1.4, alternate_scale: float = 0.6) -> Column:
    """The offset to apply to line times that differ by ``delta`` from the audio: the one given, if any; else delta, scaled,
    where it lies between ``dead`` and ``plain``. Beyond that it is suspicious, and applied only if positive, allowed and
    ``most`` at most. Differences within ``scaled``, and large negative ones if wished, are scaled by ``scale`` as well. A
    negative offset that comes to ``moderate`` at most is left out if wished."""
    size, factor = F.abs(delta), F.when(alternate, alternate_scale).otherwise(1.0)
    shrunk = size.between(*scaled) | large_negative & (delta < 0) & (size >= scaled[0])
    offset = delta * factor * F.when(shrunk, F.greatest(F.lit(0.0), F.lit(scale) if isinstance(scale, float) else scale)).otherwise(1.0)
    suspicious = (size > plain) & (size <= most)
    return (
        F.when(given.isNotNull(), given).when(suspicious & (delta > 0) & allow_positive, delta * factor).when(suspicious, 0.0)
        .when(suppress_negative & (delta < 0) & (F.abs(offset) <= moderate), 0.0).when((size > dead) & (size <= plain), offset).otherwise(0.0)
    )


def failure_mode(df: DataFrame, terms: Mapping[str, str] = FAILURE_TERMS, cases: Cases = FAILURES) -> DataFrame:
    """df (an alignment's metrics, hint and timing_delta_clamped) with ``failure``: the dominant one."""
    return with_terms(df, terms).withColumn("failure", first_case(cases, "mixed_or_unclear")).select(*df.columns, "failure")


def stepped(steps: Steps) -> tuple[Column, Column]:
    """The score after all steps whose predicate holds, never below 0, and their reasons by name."""
    score, reasons = F.lit(0.0), []
    for predicate, amount, labels in steps:
        holds = F.coalesce(F.expr(predicate), F.lit(False))
        score = F.greatest(F.lit(0.0), score + F.when(holds, F.expr(amount)).otherwise(0.0))
        reasons += [F.when(holds, F.lit(x)) for x in labels]
    return score, F.array_sort(F.filter(F.array(*reasons), lambda x: x.isNotNull()))


def triage(df: DataFrame, steps: Steps, least: float, digits: int = 3) -> DataFrame:
    """The rows of df (TRIAGE_METRICS, timing_quality_score, suspected, gold_available; nulls count 0) whose score exceeds
    ``least``, with triage_score and reasons."""
    known = df.withColumn("known_quality", F.col("timing_quality_score").cast("double"))
    known = known.select(*(F.col(c).alias(f"__{c}") for c in df.columns), "known_quality", "suspected", "gold_available", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in TRIAGE_METRICS))
    score, reasons = stepped(steps)
    out = known.withColumns({"triage_score": score, "reasons": reasons}).where(F.col("triage_score") > least)
    return out.select(*(F.col(f"__{c}").alias(c) for c in df.columns), F.round("triage_score", digits).alias("triage_score"), "reasons")


def triage_rankings(df: DataFrame, key: str, top: int = 5, digits: int = 3) -> DataFrame:
    """kind, place, key, triage_score and reasons: the records of likely wrong references, and of likely pipeline failures,
    ``top`` of each (a top-k report), ties by key."""
    kinds = (("likely_reference_divergence", REFERENCE_STEPS, 0.0), ("likely_pipeline_failure", PIPELINE_STEPS, 0.25))
    out = None
    for kind, steps, least in kinds:
        best = triage(df, steps, least, digits).select(F.lit(kind).alias("kind"), key, "triage_score", "reasons").orderBy(F.col("triage_score").desc(), key).limit(top)
        out = best if out is None else out.unionByName(best)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("triage_score").desc(), key)))


def override_gain(current: Column, fuzzy: Column, before: Column, advised: Column) -> Column:
    """What an override may gain: how much smaller the error of the fuzzy start is, or, where one is advised, that of the
    start before, whichever is more. Unknown errors are the current one, an unknown current error 0."""
    now = F.coalesce(current, F.lit(0.0))
    or_now = lambda e: now - F.coalesce(F.when(e != 0, e), now)
    return F.when(advised, F.greatest(or_now(fuzzy), or_now(before))).otherwise(or_now(fuzzy))


#: Terms of the verdict on an alignment; unknown metrics count 0.
VERDICT_TERMS = {
    "strong_internal": "dtw_line_coverage >= 0.85 AND dtw_word_coverage >= 0.55 AND low_confidence_ratio <= 0.12",
    "stable_agreement": "agreement_coverage_ratio <= 0 OR agreement_start_p95_abs_sec <= 0.9",
    "strong_gold": "gold_available AND gold_comparable_word_count >= 40 AND gold_word_coverage_ratio >= 0.8 AND gold_start_mean_abs_sec <= 0.65 AND gold_start_p95_abs_sec <= 1.9",
    "regression": "gold_available AND gold_downstream_regression_line_count >= greatest(6, floor(line_count * 0.1)) AND gold_downstream_regression_mean_improvement_sec >= 0.6 AND gold_pre_whisper_start_mean_abs_sec + 0.15 < gold_start_mean_abs_sec",
    "hooks_agree": "agreement_hook_boundary_eligibility_ratio >= greatest(0.85, agreement_coverage_ratio + 0.2) AND agreement_hook_boundary_text_similarity_mean >= greatest(0.9, agreement_text_similarity_mean)",
    "late_agreement": "agreement_coverage_ratio >= 0.35 AND agreement_start_p95_abs_sec > 1.2",
}
#: Verdicts in order of precedence: predicate, verdict, confidence, reasons each with its predicate.
VERDICTS = (
    ("suspected", "likely_reference_divergence", "divergence_confidence", ()),
    ("line_count < 8 OR NOT (has_dtw OR gold_available)", "insufficient_evidence", "'low'", (("insufficient_coverage", "true"),)),
    (
        "strong_internal AND stable_agreement AND (NOT gold_available OR strong_gold)", "likely_pipeline_ok", "CASE WHEN strong_gold THEN 'high' ELSE 'medium' END",
        (("strong_internal_alignment", "true"), ("gold_timing_consistent", "gold_available")),
    ),
    (
        "hint = 'review_dtw_lexical_matching' AND strong_gold AND agreement_coverage_ratio >= 0.4 AND agreement_start_p95_abs_sec <= 0.9 AND low_confidence_ratio <= 0.1", "needs_manual_review", "'medium'",
        (("review_dtw_lexical_matching", "true"), ("gold_timing_consistent", "true"), ("agreement_consistent", "true"), ("hook_boundary_variants_dominant", "hook_boundary_variant_ratio >= 0.25"), ("hook_normalized_agreement_consistent", "hooks_agree")),
    ),
    ("regression", "needs_pipeline_work", "'high'", (("downstream_regression_dominant", "true"), ("pre_whisper_timing_stronger_than_final", "true"))),
    (
        "dtw_line_coverage < 0.75 OR dtw_word_coverage < 0.45 OR low_confidence_ratio > 0.2 OR (late_agreement AND NOT strong_gold)", "needs_pipeline_work", "'high'",
        (("low_dtw_line_coverage", "dtw_line_coverage < 0.75"), ("low_dtw_word_coverage", "dtw_word_coverage < 0.45"), ("high_low_confidence_ratio", "low_confidence_ratio > 0.2"), ("high_agreement_p95", "late_agreement AND NOT strong_gold")),
    ),
    ("true", "needs_manual_review", "'medium'", (("mixed_signals", "true"),)),
)
VERDICT_METRICS = (
    "line_count", "dtw_line_coverage", "dtw_word_coverage", "low_confidence_ratio", "agreement_coverage_ratio", "agreement_start_p95_abs_sec", "agreement_text_similarity_mean", "gold_word_coverage_ratio", "gold_start_mean_abs_sec", "gold_start_p95_abs_sec",
    "gold_pre_whisper_start_mean_abs_sec", "gold_downstream_regression_line_count", "gold_downstream_regression_mean_improvement_sec", "gold_comparable_word_count", "hook_boundary_variant_ratio", "agreement_hook_boundary_eligibility_ratio",
    "agreement_hook_boundary_text_similarity_mean",
)


def quality_verdict(df: DataFrame, terms: Mapping[str, str] = VERDICT_TERMS, verdicts=VERDICTS) -> DataFrame:
    """df (VERDICT_METRICS, gold_available, suspected, divergence_confidence, divergence_evidence and hint) with verdict,
    confidence and reasons: those of the first verdict whose predicate holds, by name, with the hint after the first two."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("gold_available", "suspected")]
    known = df.select(*(F.col(c).alias(f"__{c}") for c in df.columns), *flags, "hint", F.coalesce("divergence_confidence", F.lit("medium")).alias("divergence_confidence"), "divergence_evidence", F.col("dtw_line_coverage").isNotNull().alias("has_dtw"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in VERDICT_METRICS))
    known = with_terms(known, terms)
    hinted = F.when(F.col("hint").isNotNull() & ~F.col("hint").isin("", "none"), F.concat(F.lit("policy_hint:"), F.col("hint")))
    told = F.when(F.size("divergence_evidence") > 0, F.col("divergence_evidence")).otherwise(F.array(F.lit("reference_divergence_suspected")))
    cases = []
    for k, (predicate, verdict, confidence, reasons) in enumerate(verdicts):
        own = told if k == 0 else F.array(*[F.when(F.expr(p), F.lit(r)) for r, p in reasons], *([hinted] if k > 1 else []))
        cases.append(F.when(F.coalesce(F.expr(predicate), F.lit(False)), F.struct(F.lit(verdict).alias("verdict"), F.expr(confidence).alias("confidence"), F.array_sort(F.array_distinct(F.filter(own, lambda r: r.isNotNull()))).alias("reasons"))))
    out = known.withColumn("__found", F.coalesce(*cases))
    return out.select(*(F.col(f"__{c}").alias(c) for c in df.columns), "__found.*")


#: What keeps a line out of a comparison, in order: reason and predicate.
LINE_GUARDS = (
    ("insufficient_window_words_for_long_line", "n_words >= 6 AND window_words < greatest(2, floor(0.35 * n_words))"),
    ("low_window_confidence_and_sparse_words", "n_words >= 5 AND window_prob < 0.45 AND window_words < greatest(2, floor(0.5 * n_words))"),
    ("explicit_window_too_sparse", "has_window AND n_words >= 4 AND window_words < 2"),
    ("missing_line_start", "start IS NULL"),
    ("missing_anchor_start", "anchor_start IS NULL"),
    ("anchor_outside_window", "anchor_start < window_start - 1.0 OR anchor_start > window_end + 1.0"),
)
#: What rescues a line whose text is less like its anchor's than asked; ``delta`` is the seconds between their starts.
#: Bounds made of least_overlap are rounded: as doubles 0.5 - 0.35 exceeds 0.15, and an overlap of 0.15 would miss it.
LINE_RESCUES = (
    "n_words >= 5 AND delta <= 0.22 AND overlap >= greatest(0.82, round(least_overlap + 0.25, 9)) AND window_words >= greatest(3, floor(0.6 * n_words)) AND window_prob >= 0.55",
    "n_words BETWEEN 3 AND 4 AND delta <= 0.12 AND overlap >= greatest(0.9, round(least_overlap + 0.35, 9)) AND window_words >= n_words AND window_prob >= 0.65",
    "n_words >= 3 AND delta <= 0.14 AND overlap >= greatest(0.72, round(least_overlap + 0.22, 9)) AND window_words >= greatest(2, floor(0.5 * n_words)) AND window_prob >= 0.55",
    "n_words >= 4 AND delta <= 0.2 AND overlap >= greatest(0.15, round(least_overlap - 0.35, 9)) AND window_words >= greatest(2, floor(0.4 * n_words)) AND window_prob >= 0.55",
)
LINE_COLUMNS = ("n_words", "window_words", "window_prob", "start", "anchor_start", "window_start", "window_end", "similarity", "overlap", "leads")


def line_eligibility(df: DataFrame, least_similarity: float, least_overlap: float, guards: Cases = LINE_GUARDS, rescues: Iterable[str] = LINE_RESCUES) -> DataFrame:
    """df (LINE_COLUMNS) with skip_reason, eligible, delta and rescued: whether a line takes part in a comparison with its
    anchor, and why not.

    Lines that a guard keeps out aren't eligible. Of the others those are skipped whose first content word is not among the
    first words of their window although the start is 0.8 seconds off (``leads``: whether it is there, null if unknown),
    and those less like their anchor than asked, in text or tokens, that nothing rescues. Null window_words count 0.
    """
    known = df.select(*(F.col(c).alias(f"__{c}") for c in df.columns), *(c for c in LINE_COLUMNS if c != "window_words"), F.col("window_words").isNotNull().alias("has_window"), F.coalesce("window_words", F.lit(0)).alias("window_words"), F.lit(float(least_overlap)).alias("least_overlap"))
    known = known.withColumns({"delta": F.abs(F.col("start") - F.col("anchor_start")), "__guard": F.coalesce(*[F.when(F.coalesce(F.expr(p), F.lit(False)), F.lit(r)) for r, p in guards])})
    rescue = F.lit(False)
    for p in rescues:
        rescue = rescue | F.coalesce(F.expr(p), F.lit(False))
    known = known.withColumn("__rescue", rescue)
    absent = F.expr("delta >= 0.8 AND NOT leads AND overlap >= greatest(0.6, round(least_overlap + 0.1, 9))")
    unlike, apart = F.col("similarity") < least_similarity, F.col("overlap") < least_overlap
    reason = F.coalesce("__guard", F.when(absent, "missing_window_line_start"), F.when(~F.col("__rescue") & unlike, "low_text_similarity"), F.when(~F.col("__rescue") & apart, "low_token_overlap"))
    out = known.withColumns({"__reason": reason, "__eligible": F.col("__guard").isNull()})
    return out.select(*(F.col(f"__{c}").alias(c) for c in df.columns), F.col("__reason").alias("skip_reason"), F.col("__eligible").alias("eligible"), "delta", (F.col("__reason").isNull() & F.col("__rescue") & unlike).alias("rescued"))
