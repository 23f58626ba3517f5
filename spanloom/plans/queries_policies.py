"""Queries for policies, quality scores and triage, over metrics made from each part's key so that every branch is reached."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import policies as po
from spanloom.sources.tables import table

from .base import query, rounded

#: Metrics made from a part's key: multiplier, modulus, divisor, offset.
METRICS = {
    "dtw_line_coverage": (37, 61, 100, 0.4), "dtw_word_coverage": (53, 71, 100, 0.3), "low_confidence_ratio": (7, 31, 100, 0), "agreement_coverage_ratio": (17, 101, 100, 0), "agreement_text_similarity_mean": (29, 21, 100, 0.8),
    "agreement_start_p95_abs_sec": (13, 50, 20, 0), "agreement_bad_ratio": (23, 41, 100, 0), "whisper_anchor_start_p95_abs_sec": (19, 50, 20, 0), "gold_word_coverage_ratio": (43, 61, 100, 0.4), "gold_start_mean_abs_sec": (11, 31, 20, 0),
    "gold_start_p95_abs_sec": (31, 41, 20, 0), "gold_comparable_word_count": (5, 37, 1, 0), "gold_word_count": (9, 83, 1, 0), "hook_boundary_variant_ratio": (15, 43, 100, 0), "agreement_hook_boundary_eligibility_ratio": (27, 51, 100, 0.5),
    "agreement_hook_boundary_text_similarity_mean": (33, 31, 100, 0.7), "divergence_score": (3, 13, 2, 0), "agreement_eligibility_ratio": (39, 81, 100, 0.2), "agreement_match_ratio_within_eligible": (47, 71, 100, 0.3),
    "truncation_pattern_ratio": (21, 29, 100, 0), "repetitive_phrase_line_ratio": (51, 47, 1000, 0), "anchor_outside_window": (57, 5, 1, 0), "low_text_similarity": (59, 3, 1, 0), "low_token_overlap": (67, 2, 1, 0),
    "gold_downstream_regression_line_count": (69, 11, 1, 0), "gold_downstream_regression_mean_improvement_sec": (63, 17, 10, 0), "gold_pre_whisper_start_mean_abs_sec": (49, 23, 20, 0),
    "matched_ratio": (41, 23, 100, 0.7), "line_coverage": (61, 29, 100, 0.7), "phonetic_similarity_coverage": (71, 13, 20, 0.1), "avg_similarity": (73, 37, 100, 0.6), "high_similarity_ratio": (79, 41, 100, 0.5), "exact_match_ratio": (83, 53, 100, 0.2),
    "line_count": (25, 53, 1, 5), "mismatch": (87, 45, 2, 0), "delta": (91, 131, 10, -6.5), "coverage": (93, 61, 100, 0.4), "density": (97, 31, 20, 1), "n_lines": (35, 23, 1, 0), "large_gaps": (45, 6, 1, 0), "issues": (55, 6, 1, 0),
}
#: Flags: multiplier, modulus and the rest at which they hold.
FLAGS = {"suspected": (1, 3, 0), "gold_available": (1, 4, 1), "timing_delta_clamped": (7, 5, 2), "tried": (1, 5, 0), "recoverable": (1, 2, 0), "padding": (1, 7, 3), "duration_match": (3, 4, 1), "alternate": (5, 7, 2), "large_negative": (3, 5, 1), "allow_positive": (1, 2, 1), "suppress_negative": (2, 3, 1), "advised": (3, 7, 4)}
#: Metrics that are unknown for some parts: those whose key leaves this rest.
UNKNOWN = {"dtw_line_coverage": (9, 4), "dtw_word_coverage": (11, 3)}
METHODS = ["whisper_hybrid", "onset_refined", "lrc_only", "genius_fallback", "none", "other"]
HINT = "review_dtw_lexical_matching"


def _made(spark, d):
    made = {k: (F.lit(float(o)) + (F.col("p_partkey") * a % b) / c) for k, (a, b, c, o) in METRICS.items()}
    made |= {k: F.when(F.col("p_partkey") % m != r, made[k]) for k, (m, r) in UNKNOWN.items()}
    flags = {k: F.col("p_partkey") * a % m == r for k, (a, m, r) in FLAGS.items()}
    return table(spark, d, "part").select("p_partkey", *(v.alias(k) for k, v in made.items()), *(v.alias(k) for k, v in flags.items()), F.when(F.col("p_partkey") % 2 == 0, HINT).alias("hint"), F.element_at(F.array(*map(F.lit, METHODS)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("method"))


def _sql() -> str:
    """The made-up metrics as a common table m."""
    made = {k: f"{float(o)}::DOUBLE + (p_partkey * {a} % {b}) / {c}" for k, (a, b, c, o) in METRICS.items()}
    made |= {k: f"CASE WHEN p_partkey % {m} <> {r} THEN {made[k]} END" for k, (m, r) in UNKNOWN.items()}
    flags = [f"p_partkey * {a} % {m} = {r} AS {k}" for k, (a, m, r) in FLAGS.items()]
    methods = "[" + ", ".join(f"'{m}'" for m in METHODS) + "][p_partkey % 6 + 1] AS method"
    return "m AS (SELECT p_partkey, " + ", ".join([*(f"{v} AS {k}" for k, v in made.items()), *flags, f"CASE WHEN p_partkey % 2 = 0 THEN '{HINT}' END AS hint", methods]) + " FROM part)"


M = _sql()


def _unit(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


@query(
    f"""WITH {M}, a AS (SELECT *, dtw_line_coverage IS NOT NULL AND dtw_word_coverage IS NOT NULL AS dtw, 0.45 * {_unit("agreement_coverage_ratio / 0.5")} + 0.35 * (1 - {_unit("agreement_start_p95_abs_sec / 1.5")}) + 0.2 * (1 - {_unit("agreement_bad_ratio / 0.25")}) AS agreement FROM m),
 b AS (SELECT *, CASE WHEN dtw THEN 0.42 * {_unit("dtw_line_coverage")} + 0.26 * {_unit("dtw_word_coverage")} + 0.22 * (1 - {_unit("low_confidence_ratio / 0.25")}) + 0.1 * agreement ELSE 0.7 * (1 - {_unit("whisper_anchor_start_p95_abs_sec / 2")}) + 0.3 * (1 - {_unit("low_confidence_ratio / 0.25")}) END AS own,
   0.35 * {_unit("gold_word_coverage_ratio")} + 0.65 * (1 - {_unit("gold_start_mean_abs_sec / 1.25")}) AS gold FROM a),
 c AS (SELECT *, CASE WHEN gold_comparable_word_count >= 20 THEN 0.78 * own + 0.22 * gold WHEN gold_word_count <= 40 AND gold_comparable_word_count >= 8 AND gold_word_coverage_ratio >= 0.75 THEN least(own, gold) ELSE own END AS score,
   CASE WHEN dtw THEN 'dtw_internal' ELSE 'anchor_fallback' END || CASE WHEN gold_comparable_word_count >= 20 THEN '+gold' WHEN gold_word_count <= 40 AND gold_comparable_word_count >= 8 AND gold_word_coverage_ratio >= 0.75 THEN '+gold_clip' ELSE '' END AS mode FROM b)
 SELECT p_partkey, round(score, 7) AS score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS band, mode FROM c"""
)
def timing_qualities(spark, d):
    return po.timing_quality(_made(spark, d), 7).select("p_partkey", F.col("timing_quality_score").alias("score"), F.col("timing_quality_band").alias("band"), F.col("timing_quality_mode").alias("mode"))


@query(
    f"""WITH {M} SELECT p_partkey,
  greatest(20, least(100, 40 + 20 * matched_ratio + 15 * avg_similarity + 10 * line_coverage + 10 * phonetic_similarity_coverage + 3 * high_similarity_ratio + 2 * exact_match_ratio)) AS dtw,
  greatest(0, least(100, round(coverage * 100) + CASE method WHEN 'whisper_hybrid' THEN 10 WHEN 'onset_refined' THEN 5 WHEN 'genius_fallback' THEN -20 WHEN 'none' THEN -50 ELSE 0 END - 5 * issues)) AS alignment,
  CASE WHEN n_lines < 1 THEN 0 WHEN n_lines < 2 THEN 20 ELSE greatest(0, 100 - CASE WHEN coverage < 0.6 THEN 30 WHEN coverage < 0.8 THEN 15 ELSE 0 END - CASE WHEN density < 1.5 THEN 20 WHEN density < 2 THEN 10 ELSE 0 END
    - CASE WHEN duration_match THEN 0 ELSE 20 END - CASE WHEN n_lines < 10 THEN 15 ELSE 0 END - CASE WHEN large_gaps > 2 THEN 10 ELSE 0 END) END::DOUBLE AS lyrics FROM m"""
)
def quality_scores(spark, d):
    rows = po.lyric_quality(_made(spark, d))
    metrics = {k: F.col(k) for k in po.DTW_POINTS}
    return rounded(rows.select("p_partkey", po.dtw_score(metrics).alias("dtw"), po.alignment_score(F.round(F.col("coverage") * 100), F.col("method"), F.col("issues")).alias("alignment"), F.col("quality").alias("lyrics")), 6)


@query(
    f"""WITH {M} SELECT p_partkey, NOT (mismatch >= 12 AND NOT padding AND recoverable) AS keep,
  CASE WHEN mismatch < 12 THEN 'degraded_duration_mismatch' WHEN padding THEN 'degraded_outro_padding' WHEN recoverable THEN 'dropped_duration_mismatch' ELSE 'degraded_duration_mismatch' END AS mode,
  CASE WHEN mismatch < 12 THEN 'duration_mismatch_not_severe' WHEN padding THEN 'likely_trailing_outro_padding' WHEN recoverable THEN 'severe_mismatch_with_audio_recovery' ELSE 'severe_mismatch_without_audio_recovery' END AS reason,
  NOT tried AND line_count >= 25 AND matched_ratio >= 0.78 AND matched_ratio <= 0.88 AND line_coverage >= 0.8 AND line_coverage <= 0.92 AND phonetic_similarity_coverage >= 0.35 AS retry FROM m"""
)
def trust_and_retry(spark, d):
    return po.should_retry(po.trust_policy(_made(spark, d))).select("p_partkey", "keep", "mode", "reason", "retry")


@query(
    f"""WITH {M}, s AS (SELECT *, CASE WHEN alternate THEN 0.6 ELSE 1 END AS f, CASE WHEN abs(delta) >= 0.8 AND abs(delta) <= 1.6 OR large_negative AND delta < 0 AND abs(delta) >= 0.8 THEN 0.5 ELSE 1 END AS g FROM m)
 SELECT p_partkey, round(CASE WHEN p_partkey % 17 = 0 THEN 0.25 WHEN allow_positive AND delta > 2.5 AND delta <= 5 THEN delta * f WHEN abs(delta) > 2.5 AND abs(delta) <= 5 THEN 0
   WHEN suppress_negative AND delta < 0 AND abs(delta * f * g) <= 1.4 THEN 0 WHEN abs(delta) > 0.3 AND abs(delta) <= 2.5 THEN delta * f * g ELSE 0 END, 6)::DOUBLE AS applied FROM s"""
)
def auto_offsets(spark, d):
    flag = [F.col(c) for c in ("large_negative", "allow_positive", "suppress_negative")]
    given = F.when(F.col("p_partkey") % 17 == 0, 0.25)
    return rounded(_made(spark, d).select("p_partkey", po.auto_offset(F.col("delta"), given, F.col("alternate"), 0.5, (0.8, 1.6), *flag).alias("applied")), 6)


@query(
    f"""WITH {M}, z AS (SELECT p_partkey, hint, coalesce(dtw_line_coverage, 0) AS cov, low_confidence_ratio AS low, agreement_coverage_ratio AS agree, agreement_start_p95_abs_sec AS p95, agreement_eligibility_ratio AS elig, agreement_match_ratio_within_eligible AS matched,
  gold_word_coverage_ratio AS gold, gold_start_mean_abs_sec AS off, hook_boundary_variant_ratio AS hook, truncation_pattern_ratio AS trunc, repetitive_phrase_line_ratio AS rep, low_text_similarity + low_token_overlap AS lex,
  anchor_outside_window + CASE WHEN timing_delta_clamped THEN 2 ELSE 0 END AS again, gold_downstream_regression_line_count AS worse, gold_downstream_regression_mean_improvement_sec AS gained, gold_pre_whisper_start_mean_abs_sec AS pre FROM m),
 r AS (SELECT *, coalesce(hint = 'review_dtw_lexical_matching', false) AND gold >= 0.75 AND off <= 0.5 AND agree >= 0.4 AND p95 <= 0.9 AND low <= 0.1 AND (hook >= 0.12 OR trunc >= 0.15 OR rep >= 0.02) AS review FROM z)
 SELECT p_partkey, CASE WHEN review AND hook >= 0.25 THEN 'lexical_hook_boundary_variants' WHEN review THEN 'lexical_hook_variant_matching' WHEN again >= 3 AND lex <= 1 AND matched < 0.75 THEN 'repetition_handling'
  WHEN worse >= 6 AND gained >= 0.6 AND pre + 0.15 < off THEN 'downstream_timing_regression' WHEN cov >= 0.7 AND p95 >= 1.1 AND elig >= 0.6 AND matched >= 0.45 THEN 'timing_drift'
  WHEN agree < 0.25 OR elig < 0.35 OR lex >= 2 THEN 'sparse_lexical_comparability' WHEN cov >= 0.6 AND p95 > 0.9 THEN 'timing_drift' ELSE 'mixed_or_unclear' END AS failure FROM r"""
)
def failure_modes(spark, d):
    return po.failure_mode(_made(spark, d)).select("p_partkey", "failure")


#: To seven digits: fewer would leave ties, which the two engines round each in its own way.
TRIAGE = f"""{M}, q AS (SELECT p_partkey, suspected, gold_available, coalesce(dtw_line_coverage, 0) AS ln, coalesce(dtw_word_coverage, 0) AS wd, low_confidence_ratio AS low, agreement_coverage_ratio AS agree, agreement_text_similarity_mean AS sim, agreement_start_p95_abs_sec AS p95,
  agreement_bad_ratio AS bad, CASE WHEN p_partkey % 10 <> 6 THEN coverage END AS quality, gold_word_coverage_ratio AS gold, gold_start_mean_abs_sec AS off, gold_start_p95_abs_sec AS off95, hook_boundary_variant_ratio AS hook, agreement_hook_boundary_eligibility_ratio AS elig,
  agreement_hook_boundary_text_similarity_mean AS hsim, least(divergence_score, 4) AS div FROM m),
 c AS (SELECT *, greatest(0.3, least(1, agree / 0.5)) AS rel, NOT gold_available AND ln <= 0.6 AND wd <= 0.45 AND agree >= 0.07 AND sim >= 0.9 AND p95 <= 1.2 AND low <= 0.08 AS anchored, hook >= 0.25 AND elig >= greatest(0.85, agree + 0.2) AND hsim >= 0.9 AND p95 <= 0.9 AND low <= 0.1 AS hooks,
  coalesce(ln >= 0.95 AND wd >= 0.95 AND low <= 0.05 AND agree >= 0.9 AND gold >= 0.95 AND off <= 0.25 AND off95 <= 0.5 AND quality >= 0.9, false) AS consistent FROM q),
 s1 AS (SELECT *, CASE WHEN ln < 0.75 THEN (0.75 - ln) * 2 ELSE 0 END + CASE WHEN wd < 0.6 THEN (0.6 - wd) * 1.5 ELSE 0 END + CASE WHEN low > 0.1 THEN least(low, 0.5) ELSE 0 END + CASE WHEN p95 > 1 THEN least((p95 - 1) / 2, 1.5) * rel ELSE 0 END
   + CASE WHEN bad > 0.1 THEN (bad - 0.1) * 2 * rel ELSE 0 END + CASE WHEN quality < 0.55 THEN least((0.55 - quality) * 2, 0.8) ELSE 0 END AS x FROM c),
 s2 AS (SELECT *, CASE WHEN quality >= 0.78 THEN greatest(0, x - 0.2) ELSE x END AS x2 FROM s1), s3 AS (SELECT *, CASE WHEN hooks THEN greatest(0, x2 - 0.45) ELSE x2 END AS x3 FROM s2),
 s4 AS (SELECT *, CASE WHEN suspected THEN greatest(0, x3 - 1) ELSE x3 END AS x4 FROM s3), s5 AS (SELECT *, CASE WHEN consistent THEN greatest(0, x4 - 0.9) ELSE x4 END AS x5 FROM s4),
 f AS (SELECT p_partkey, CASE WHEN suspected THEN 2 + div / 2 ELSE 0 END + CASE WHEN anchored THEN 1 ELSE 0 END AS reference, x5 AS pipeline,
  array_to_string(list_sort(list_filter([CASE WHEN suspected THEN 'reference_divergence_suspected' END, CASE WHEN anchored THEN 'low_dtw_with_strong_anchor_agreement' END], lambda z: z IS NOT NULL)), ',') AS reference_reasons,
  array_to_string(list_sort(list_filter([CASE WHEN ln < 0.75 THEN 'low_dtw_line_coverage' END, CASE WHEN wd < 0.6 THEN 'low_dtw_word_coverage' END, CASE WHEN low > 0.1 THEN 'high_low_confidence_ratio' END, CASE WHEN p95 > 1 THEN 'high_agreement_p95' END,
   CASE WHEN bad > 0.1 THEN 'high_agreement_bad_ratio' END, CASE WHEN quality < 0.55 THEN 'low_timing_quality_score' END, CASE WHEN quality >= 0.78 THEN 'timing_quality_score_good' END, CASE WHEN hooks THEN 'hook_boundary_variants_dominant' END,
   CASE WHEN hooks THEN 'hook_normalized_agreement_consistent' END, CASE WHEN suspected THEN 'downgraded_due_to_reference_divergence' END, CASE WHEN consistent THEN 'gold_timing_consistent_despite_anchor_disagreement' END], lambda z: z IS NOT NULL)), ',') AS pipeline_reasons FROM s5)"""


def _triaged(spark, d):
    return _made(spark, d).withColumn("timing_quality_score", F.when(F.col("p_partkey") % 10 != 6, F.col("coverage")))


@query(f"WITH {TRIAGE} SELECT p_partkey, round(pipeline, 7) AS score, pipeline_reasons AS reasons FROM f WHERE pipeline > 0.25")
def pipeline_triage(spark, d):
    out = po.triage(_triaged(spark, d), po.PIPELINE_STEPS, 0.25, 7)
    return out.select("p_partkey", F.col("triage_score").alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {TRIAGE} SELECT p_partkey, round(reference, 7) AS score, reference_reasons AS reasons FROM f WHERE reference > 0")
def reference_triage(spark, d):
    out = po.triage(_triaged(spark, d), po.REFERENCE_STEPS, 0.0, 7)
    return out.select("p_partkey", F.col("triage_score").alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {TRIAGE}, k AS (SELECT 'likely_reference_divergence' AS kind, p_partkey, round(reference, 7) AS score, reference_reasons AS reasons FROM f WHERE reference > 0 UNION ALL SELECT 'likely_pipeline_failure', p_partkey, round(pipeline, 7), pipeline_reasons FROM f WHERE pipeline > 0.25),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, p_partkey) AS place FROM k) SELECT kind, place::INTEGER AS place, p_partkey, score, reasons FROM r WHERE place <= 5"""
)
def triage_reports(spark, d):
    """The five records of each kind that are most worth a look."""
    out = po.triage_rankings(_triaged(spark, d), "p_partkey", digits=7)
    return out.select("kind", "place", "p_partkey", F.col("triage_score").alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {M}, g AS (SELECT p_partkey, advised, gold_start_mean_abs_sec AS now, coalesce(nullif(gold_pre_whisper_start_mean_abs_sec, 0), gold_start_mean_abs_sec) AS fuzzy, coalesce(nullif(gold_start_p95_abs_sec, 0), gold_start_mean_abs_sec) AS pre FROM m),
 x AS (SELECT p_partkey, now, CASE WHEN advised THEN greatest(now - fuzzy, now - pre) ELSE now - fuzzy END AS gain FROM g)
 SELECT p_partkey, round(gain, 6) AS gain, row_number() OVER (ORDER BY round(gain, 6) DESC, now DESC, p_partkey) AS place FROM x WHERE round(gain, 6) > 0 QUALIFY place <= 100"""
)
def override_gains(spark, d):
    """The hundred overrides that may gain most (a top-k report)."""
    gain = po.override_gain(F.col("gold_start_mean_abs_sec"), F.col("gold_pre_whisper_start_mean_abs_sec"), F.col("gold_start_p95_abs_sec"), F.col("advised"))
    rows = rounded(_made(spark, d).select("p_partkey", F.col("gold_start_mean_abs_sec").alias("now"), gain.alias("gain")), 6).where("gain > 0")
    top = rows.orderBy(F.col("gain").desc(), F.col("now").desc(), "p_partkey").limit(100)
    return top.select("p_partkey", "gain", F.row_number().over(Window.orderBy(F.col("gain").desc(), F.col("now").desc(), "p_partkey")).cast("long").alias("place"))


VERDICT_SQL = f"""{M}, q AS (SELECT p_partkey, hint, suspected, gold_available AS has_gold, dtw_line_coverage IS NOT NULL AS has_dtw, line_count AS n, coalesce(dtw_line_coverage, 0) AS ln, coalesce(dtw_word_coverage, 0) AS wd, low_confidence_ratio AS low, agreement_coverage_ratio AS agree,
  agreement_start_p95_abs_sec AS p95, agreement_text_similarity_mean AS sim, gold_word_coverage_ratio AS gold, gold_start_mean_abs_sec AS off, gold_start_p95_abs_sec AS off95, gold_comparable_word_count * 2 AS words, hook_boundary_variant_ratio AS hook, agreement_hook_boundary_eligibility_ratio AS elig,
  agreement_hook_boundary_text_similarity_mean AS hsim, gold_downstream_regression_line_count AS worse, gold_downstream_regression_mean_improvement_sec AS gained, gold_pre_whisper_start_mean_abs_sec AS pre FROM m),
 s AS (SELECT *, has_gold AND words >= 40 AND gold >= 0.8 AND off <= 0.65 AND off95 <= 1.9 AS sg FROM q),
 v AS (SELECT *, CASE WHEN suspected THEN 1 WHEN n < 8 OR NOT has_dtw AND NOT has_gold THEN 2 WHEN ln >= 0.85 AND wd >= 0.55 AND low <= 0.12 AND (agree <= 0 OR p95 <= 0.9) AND (NOT has_gold OR sg) THEN 3
  WHEN coalesce(hint = 'review_dtw_lexical_matching', false) AND sg AND agree >= 0.4 AND p95 <= 0.9 AND low <= 0.1 THEN 4 WHEN has_gold AND worse >= greatest(6, floor(n * 0.1)) AND gained >= 0.6 AND pre + 0.15 < off THEN 5
  WHEN ln < 0.75 OR wd < 0.45 OR low > 0.2 OR agree >= 0.35 AND p95 > 1.2 AND NOT sg THEN 6 ELSE 7 END AS k FROM s)
 SELECT p_partkey, CASE k WHEN 1 THEN 'likely_reference_divergence' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN 'likely_pipeline_ok' WHEN 4 THEN 'needs_manual_review' WHEN 5 THEN 'needs_pipeline_work' WHEN 6 THEN 'needs_pipeline_work' ELSE 'needs_manual_review' END AS verdict,
  CASE WHEN k = 1 THEN 'medium' WHEN k = 2 THEN 'low' WHEN k = 3 AND sg THEN 'high' WHEN k IN (5, 6) THEN 'high' ELSE 'medium' END AS confidence,
  array_to_string(list_sort(list_filter([CASE WHEN k = 1 AND p_partkey % 2 = 0 THEN 'seen' END, CASE WHEN k = 1 AND p_partkey % 2 <> 0 THEN 'reference_divergence_suspected' END, CASE WHEN k = 2 THEN 'insufficient_coverage' END, CASE WHEN k = 3 THEN 'strong_internal_alignment' END,
   CASE WHEN k = 3 AND has_gold OR k = 4 THEN 'gold_timing_consistent' END, CASE WHEN k = 4 THEN 'review_dtw_lexical_matching' END, CASE WHEN k = 4 THEN 'agreement_consistent' END, CASE WHEN k = 4 AND hook >= 0.25 THEN 'hook_boundary_variants_dominant' END,
   CASE WHEN k = 4 AND elig >= greatest(0.85, agree + 0.2) AND hsim >= greatest(0.9, sim) THEN 'hook_normalized_agreement_consistent' END, CASE WHEN k = 5 THEN 'downstream_regression_dominant' END, CASE WHEN k = 5 THEN 'pre_whisper_timing_stronger_than_final' END,
   CASE WHEN k = 6 AND ln < 0.75 THEN 'low_dtw_line_coverage' END, CASE WHEN k = 6 AND wd < 0.45 THEN 'low_dtw_word_coverage' END, CASE WHEN k = 6 AND low > 0.2 THEN 'high_low_confidence_ratio' END, CASE WHEN k = 6 AND agree >= 0.35 AND p95 > 1.2 AND NOT sg THEN 'high_agreement_p95' END,
   CASE WHEN k = 7 THEN 'mixed_signals' END, CASE WHEN k > 2 THEN 'policy_hint:' || hint END], lambda z: z IS NOT NULL)), ',') AS reasons FROM v"""


@query(f"WITH {VERDICT_SQL}")
def quality_verdicts(spark, d):
    evidence = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("seen")))
    rows = _made(spark, d).withColumns({"gold_comparable_word_count": F.col("gold_comparable_word_count") * 2, "divergence_confidence": F.lit(None).cast("string"), "divergence_evidence": evidence})
    return po.quality_verdict(rows).select("p_partkey", "verdict", "confidence", F.array_join("reasons", ",").alias("reasons"))


#: Lines made of lineitem: words, window, starts and likeness.
LINES = """m AS (SELECT l_orderkey, l_linenumber, (l_partkey % 9 + 1)::DOUBLE AS n_words, CASE WHEN l_suppkey % 6 <> 0 THEN (l_suppkey * 7 % 9)::DOUBLE END AS window_words, CASE WHEN l_partkey % 8 <> 3 THEN 0.3 + (l_partkey * 11 % 61) / 100 END AS window_prob,
  CASE WHEN l_suppkey % 13 <> 4 THEN 10 + l_linenumber::DOUBLE END AS s, CASE WHEN l_partkey % 17 <> 5 THEN 10 + l_linenumber + ((l_partkey * 3 + l_suppkey) % 41 - 20) / 20 END AS a, 8 + l_linenumber + (l_suppkey % 5) / 2 AS ws, 11 + l_linenumber + (l_partkey % 5) / 2 AS we,
  (l_partkey * 13 % 101) / 100 AS sim, (l_suppkey * 17 % 101) / 100 AS ov, CASE WHEN l_suppkey % 4 <> 2 THEN l_partkey % 2 = 0 END AS leads FROM lineitem)"""


@query(
    f"""WITH {LINES}, d AS (SELECT *, abs(s - a) AS delta, coalesce(window_words, 0) AS ww FROM m),
 g AS (SELECT *, CASE WHEN n_words >= 6 AND ww < greatest(2, floor(0.35 * n_words)) THEN 'insufficient_window_words_for_long_line' WHEN n_words >= 5 AND window_prob < 0.45 AND ww < greatest(2, floor(0.5 * n_words)) THEN 'low_window_confidence_and_sparse_words'
  WHEN window_words IS NOT NULL AND n_words >= 4 AND ww < 2 THEN 'explicit_window_too_sparse' WHEN s IS NULL THEN 'missing_line_start' WHEN a IS NULL THEN 'missing_anchor_start' WHEN a < ws - 1 OR a > we + 1 THEN 'anchor_outside_window' END AS guard,
  coalesce(n_words >= 5 AND delta <= 0.22 AND ov >= 0.82 AND ww >= greatest(3, floor(0.6 * n_words)) AND window_prob >= 0.55, false) OR coalesce(n_words >= 3 AND n_words <= 4 AND delta <= 0.12 AND ov >= 0.9 AND ww >= n_words AND window_prob >= 0.65, false)
  OR coalesce(n_words >= 3 AND delta <= 0.14 AND ov >= 0.72 AND ww >= greatest(2, floor(0.5 * n_words)) AND window_prob >= 0.55, false) OR coalesce(n_words >= 4 AND delta <= 0.2 AND ov >= 0.15 AND ww >= greatest(2, floor(0.4 * n_words)) AND window_prob >= 0.55, false) AS rescue FROM d),
 r AS (SELECT *, CASE WHEN guard IS NOT NULL THEN guard WHEN delta >= 0.8 AND NOT leads AND ov >= 0.6 THEN 'missing_window_line_start' WHEN NOT rescue AND sim < 0.58 THEN 'low_text_similarity' WHEN NOT rescue AND ov < 0.5 THEN 'low_token_overlap' END AS reason FROM g)
 SELECT l_orderkey, coalesce(reason, 'compared') AS reason, guard IS NULL AS eligible, reason IS NULL AND rescue AND sim < 0.58 AS rescued, count(*) AS n FROM r GROUP BY 1, 2, 3, 4"""
)
def line_eligibilities(spark, d):
    """Why lines take part in a comparison or not."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", (p % 9 + 1).cast("double").alias("n_words"), F.when(s % 6 != 0, (s * 7 % 9).cast("double")).alias("window_words"), F.when(p % 8 != 3, 0.3 + (p * 11 % 61) / 100).alias("window_prob"), F.when(s % 13 != 4, 10 + n.cast("double")).alias("start"),
        F.when(p % 17 != 5, 10 + n + ((p * 3 + s) % 41 - 20) / 20).alias("anchor_start"), (8 + n + (s % 5) / 2).alias("window_start"), (11 + n + (p % 5) / 2).alias("window_end"), (p * 13 % 101 / 100).alias("similarity"), (s * 17 % 101 / 100).alias("overlap"), F.when(s % 4 != 2, p % 2 == 0).alias("leads"),
    )
    out = po.line_eligibility(rows, 0.58, 0.5)
    return out.groupBy("l_orderkey", F.coalesce("skip_reason", F.lit("compared")).alias("reason"), "eligible", "rescued").agg(F.count("*").alias("n"))
