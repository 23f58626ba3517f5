"""Diagnoses of a record's metrics by tables of rules, and the cost of a timed match.

A diagnosis is data: named terms over the metrics, facts with weights that speak for or against a finding, and ordered
cases of which the first that holds gives the answer. All are SQL predicates over a DataFrame's columns, so a caller may
pass tables of their own; the functions here only evaluate them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Facts = Iterable[tuple[str, float, str]]
Cases = Iterable[tuple[str, str]]

#: Metrics that the tables below speak of; a null one counts as 0.
METRICS = (
    "line_count", "gold_comparable_word_count", "dtw_line_coverage", "dtw_word_coverage", "agreement_coverage_ratio", "agreement_text_similarity_mean", "agreement_start_p95_abs_sec",
    "agreement_bad_ratio", "low_confidence_ratio", "gold_word_coverage_ratio", "gold_start_mean_abs_sec", "gold_start_p95_abs_sec",
)

#: Terms of the diagnosis of the reference (besides metrics: gold_available, source_disagreement).
DIVERGENCE_TERMS = {
    "strong_dtw": "dtw_line_coverage >= 0.9 AND dtw_word_coverage >= 0.4 AND low_confidence_ratio <= 0.12",
    "strong_subset": "agreement_coverage_ratio >= 0.5 AND agreement_text_similarity_mean >= 0.9 AND low_confidence_ratio <= 0.08",
    "severe": "gold_start_mean_abs_sec >= 20 OR gold_start_p95_abs_sec >= 35",
    "against_strong_dtw": "dtw_line_coverage >= 0.88 AND dtw_word_coverage >= 0.55 AND low_confidence_ratio <= 0.12 AND agreement_coverage_ratio <= 0.12 AND gold_start_mean_abs_sec >= 10 AND gold_start_p95_abs_sec >= 18",
    "comparable": "gold_comparable_word_count >= 20 AND line_count >= 10",
    "anchored": "line_count >= 40 AND dtw_line_coverage <= 0.6 AND dtw_word_coverage <= 0.45 AND agreement_coverage_ratio >= 0.07 AND agreement_text_similarity_mean >= 0.9 AND agreement_start_p95_abs_sec <= 1.2 AND low_confidence_ratio <= 0.08",
}

#: Label, weight and predicate of what speaks for (or, below 0, against) a wrong reference.
DIVERGENCE_FACTS = (
    ("strong_dtw_internal_consistency", 1.0, "strong_dtw"),
    ("strong_lrc_whisper_agreement_subset", 1.0, "strong_subset"),
    ("low_internal_uncertainty", 0.25, "low_confidence_ratio <= 0.1"),
    ("severe_gold_timing_mismatch", 1.5, "severe"),
    ("elevated_gold_timing_mismatch", 0.5, "NOT severe AND gold_start_mean_abs_sec >= 10 AND gold_start_p95_abs_sec >= 20"),
    ("high_gold_mismatch_with_strong_dtw", 1.25, "against_strong_dtw"),
    ("multi_source_disagreement_supports_reference_mismatch", 0.5, "against_strong_dtw AND source_disagreement"),
    ("gold_coverage_timing_combo_mismatch", 1.0, "gold_word_coverage_ratio <= 0.68 AND gold_start_mean_abs_sec >= 10"),
    ("insufficient_internal_consistency", -1.5, "NOT (strong_dtw OR strong_subset)"),
    ("weak_internal_alignment_signals", -0.5, "dtw_line_coverage < 0.75 OR low_confidence_ratio > 0.2"),
    ("high_agreement_bad_ratio", -0.5, "agreement_coverage_ratio > 0 AND agreement_bad_ratio > 0.2"),
)

#: Cases that are settled before any fact is weighed: predicate, score, confidence, evidence.
DIVERGENCE_SETTLED = (
    ("NOT gold_available AND anchored", 1.75, "medium", ("no_gold_reference", "low_dtw_with_strong_anchor_agreement")),
    ("NOT gold_available", 0.0, "low", ("no_gold_reference",)),
    ("NOT comparable", 0.0, "low", ("insufficient_comparable_coverage",)),
)

#: From these scores on a reference is suspected, and with high confidence.
SUSPECTED, CERTAIN = 2.5, 4.0

#: Terms of the hint (besides metrics: suspected, timing_delta_clamped).
HINT_TERMS = {
    "gold_mismatch": "gold_word_coverage_ratio >= 0.6 AND gold_start_mean_abs_sec >= 1 AND agreement_coverage_ratio >= 0.3 AND agreement_start_p95_abs_sec >= 1 AND (agreement_bad_ratio >= 0.1 OR timing_delta_clamped) AND dtw_line_coverage >= 0.65 AND low_confidence_ratio <= 0.15",
    "internal_mismatch": "timing_delta_clamped AND agreement_coverage_ratio >= 0.45 AND agreement_start_p95_abs_sec >= 2 AND agreement_bad_ratio >= 0.2 AND dtw_line_coverage >= 0.75 AND dtw_word_coverage >= 0.6 AND low_confidence_ratio <= 0.15",
    "strong_hybrid": "dtw_line_coverage >= 0.95 AND dtw_word_coverage >= 0.9 AND agreement_coverage_ratio >= 0.5 AND agreement_start_p95_abs_sec <= 2 AND low_confidence_ratio <= 0.05",
    "weak_words": "dtw_line_coverage >= 0.7 AND dtw_word_coverage < 0.65 AND low_confidence_ratio <= 0.1 AND gold_word_coverage_ratio >= 0.75 AND agreement_coverage_ratio >= 0.4 AND agreement_start_p95_abs_sec <= 0.9",
}

#: Hints in order of precedence.
HINTS = (
    ("reference_mismatch_review", "suspected"),
    ("timing_delta_clamped_review", "(gold_mismatch OR internal_mismatch) AND strong_hybrid"),
    ("consider_lyrics_no_timing", "gold_mismatch OR internal_mismatch"),
    ("review_dtw_lexical_matching", "weak_words"),
    ("timing_delta_clamped_review", "timing_delta_clamped"),
)


def with_terms(df: DataFrame, terms: Mapping[str, str]) -> DataFrame:
    """df with a boolean column for each term; an unknown one (null) doesn't hold."""
    return df.withColumns({name: F.coalesce(F.expr(p), F.lit(False)) for name, p in terms.items()})


def weighed(facts: Facts) -> tuple[Column, Column]:
    """The sum of the weights of the facts that hold, and their labels in order of name."""
    held = F.filter(F.array(*[F.when(F.expr(p), F.struct(F.lit(label).alias("label"), F.lit(float(w)).alias("weight"))) for label, w, p in facts]), lambda x: x.isNotNull())
    score = F.aggregate(held, F.lit(0.0), lambda total, x: total + x["weight"])
    return score, F.array_sort(F.transform(held, lambda x: x["label"]))


def first_case(cases: Cases, otherwise: str) -> Column:
    """The answer of the first case that holds."""
    return F.coalesce(*[F.when(F.expr(p), answer) for answer, p in cases], F.lit(otherwise))


def divergence(df: DataFrame, terms: Mapping[str, str] = DIVERGENCE_TERMS, facts: Facts = DIVERGENCE_FACTS, settled=DIVERGENCE_SETTLED, suspected: float = SUSPECTED, certain: float = CERTAIN) -> DataFrame:
    """df with suspected, score, confidence and evidence: whether the reference, not the result, is likely wrong.

    ``df`` has METRICS, gold_available and source_disagreement. The columns of ``terms`` go again.
    """
    known = with_terms(df.fillna(0, list(METRICS)), terms)
    score, labels = weighed(facts)
    answer = lambda s, c, e, yes: F.struct(yes.alias("suspected"), s.alias("score"), c.alias("confidence"), e.alias("evidence"))
    cases = [F.when(F.expr(p), answer(F.lit(s), F.lit(c), F.array(*map(F.lit, e)), F.lit(c != "low"))) for p, s, c, e in settled]
    confidence = F.when(F.col("__score") >= certain, "high").when(F.col("__score") >= suspected, "medium").otherwise("low")
    weighed_ = answer(F.round("__score", 3), confidence, F.col("__labels"), F.col("__score") >= suspected)
    found = known.withColumns({"__score": score, "__labels": labels}).withColumn("__found", F.coalesce(*cases, weighed_))
    return found.select(*df.columns, "__found.*")


def policy_hint(df: DataFrame, terms: Mapping[str, str] = HINT_TERMS, hints: Cases = HINTS) -> DataFrame:
    """df with ``hint``, the first that applies or "none". ``df`` has METRICS, suspected and timing_delta_clamped."""
    return with_terms(df.fillna(0, list(METRICS)), terms).withColumn("hint", first_case(hints, "none")).select(*df.columns, "hint")


def match_cost(at: Column, target: Column, segment_gap: Column, anchor: Column, place: Column, backward: float = 0.5, order: float = 0.35) -> Column:
    """Seconds apart, plus 0.4 and a hundredth of the seconds between their segments (null: same segment), plus
    ``backward`` for each second before the anchor, plus ``order`` for the difference of relative places."""
    early = F.greatest(anchor - at, F.lit(0.0))
    return F.abs(at - target) + F.coalesce(0.4 + 0.01 * F.abs(segment_gap), F.lit(0.0)) + F.coalesce(early * backward, F.lit(0.0)) + F.coalesce(F.abs(place) * order, F.lit(0.0))
