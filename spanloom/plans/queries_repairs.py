"""Queries for diagnoses of metrics and for merges and repairs of recognised rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import diagnosis as di
from spanloom.operators import repairs as rp
from spanloom.sources.tables import table

from .base import points, query, rounded, spans

#: Metrics made from a part's key: multiplier, modulus, divisor, offset.
METRICS = {
    "words": (5, 60, 1, 0), "lines": (31, 70, 1, 0), "line_cov": (37, 41, 100, 0.6), "word_cov": (53, 61, 100, 0.4), "agree_cov": (17, 61, 100, 0), "agree_sim": (29, 21, 100, 0.8),
    "agree_p95": (13, 60, 20, 0), "agree_bad": (23, 41, 100, 0), "low_conf": (7, 16, 100, 0), "gold_cov": (43, 51, 100, 0.5), "gold_mean": (11, 25, 1, 0), "gold_p95": (19, 45, 1, 0),
}
M = "m AS (SELECT p_partkey, p_partkey % 4 <> 0 AS gold, p_partkey % 3 = 0 AS flag, " + ", ".join(f"{o} + (p_partkey * {a} % {b}) / {c} AS {k}" for k, (a, b, c, o) in METRICS.items()) + " FROM part)"


def _metrics(spark, d):
    made = [(F.lit(o) + (F.col("p_partkey") * a % b) / c).alias(k) for k, (a, b, c, o) in METRICS.items()]
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4 != 0).alias("gold"), (F.col("p_partkey") % 3 == 0).alias("flag"), *made)
    return rows, {k: F.col(k) for k in METRICS}


@query(
    f"""WITH {M}, f AS (SELECT *, (line_cov >= 0.9 AND word_cov >= 0.4 AND low_conf <= 0.12) AS inside, (agree_cov >= 0.5 AND agree_sim >= 0.9 AND low_conf <= 0.08) AS subset, (gold_mean >= 20 OR gold_p95 >= 35) AS severe,
  (line_cov >= 0.88 AND word_cov >= 0.55 AND low_conf <= 0.12 AND agree_cov <= 0.12 AND gold_mean >= 10 AND gold_p95 >= 18) AS against FROM m),
 e AS (SELECT *, [CASE WHEN inside THEN ('strong_dtw_internal_consistency', 1.0::DOUBLE) END, CASE WHEN subset THEN ('strong_lrc_whisper_agreement_subset', 1.0::DOUBLE) END, CASE WHEN low_conf <= 0.1 THEN ('low_internal_uncertainty', 0.25::DOUBLE) END,
  CASE WHEN severe THEN ('severe_gold_timing_mismatch', 1.5::DOUBLE) END, CASE WHEN NOT severe AND gold_mean >= 10 AND gold_p95 >= 20 THEN ('elevated_gold_timing_mismatch', 0.5::DOUBLE) END, CASE WHEN against THEN ('high_gold_mismatch_with_strong_dtw', 1.25::DOUBLE) END,
  CASE WHEN against AND flag THEN ('multi_source_disagreement_supports_reference_mismatch', 0.5::DOUBLE) END, CASE WHEN gold_cov <= 0.68 AND gold_mean >= 10 THEN ('gold_coverage_timing_combo_mismatch', 1.0::DOUBLE) END, CASE WHEN NOT (inside OR subset) THEN ('insufficient_internal_consistency', (-1.5)::DOUBLE) END,
  CASE WHEN line_cov < 0.75 OR low_conf > 0.2 THEN ('weak_internal_alignment_signals', (-0.5)::DOUBLE) END, CASE WHEN agree_cov > 0 AND agree_bad > 0.2 THEN ('high_agreement_bad_ratio', (-0.5)::DOUBLE) END] AS ev FROM f),
 s AS (SELECT *, coalesce(list_sum(list_transform(list_filter(ev, lambda x: x IS NOT NULL), lambda x: x[2])), 0) AS raw, array_to_string(list_sort(list_transform(list_filter(ev, lambda x: x IS NOT NULL), lambda x: x[1])), ',') AS names FROM e),
 r AS (SELECT *, (lines >= 40 AND line_cov <= 0.6 AND word_cov <= 0.45 AND agree_cov >= 0.07 AND agree_sim >= 0.9 AND agree_p95 <= 1.2 AND low_conf <= 0.08) AS lone, (words < 20 OR lines < 10) AS few,
  (gold_cov >= 0.6 AND gold_mean >= 1 AND agree_cov >= 0.3 AND agree_p95 >= 1 AND (agree_bad >= 0.1 OR flag) AND line_cov >= 0.65 AND low_conf <= 0.15) OR
  (flag AND agree_cov >= 0.45 AND agree_p95 >= 2 AND agree_bad >= 0.2 AND line_cov >= 0.75 AND word_cov >= 0.6 AND low_conf <= 0.15) AS drops,
  (line_cov >= 0.95 AND word_cov >= 0.9 AND agree_cov >= 0.5 AND agree_p95 <= 2 AND low_conf <= 0.05) AS strong, (line_cov >= 0.7 AND word_cov < 0.65 AND low_conf <= 0.1 AND gold_cov >= 0.75 AND agree_cov >= 0.4 AND agree_p95 <= 0.9) AS lexical FROM s),
 o AS (SELECT *, CASE WHEN NOT gold THEN lone WHEN few THEN false ELSE raw >= 2.5 END AS suspected FROM r)
 SELECT p_partkey, suspected, round(CASE WHEN NOT gold THEN CASE WHEN lone THEN 1.75 ELSE 0 END WHEN few THEN 0 ELSE raw END, 3)::DOUBLE AS score,
  CASE WHEN NOT gold THEN CASE WHEN lone THEN 'medium' ELSE 'low' END WHEN few THEN 'low' WHEN raw >= 4 THEN 'high' WHEN raw >= 2.5 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN NOT gold THEN CASE WHEN lone THEN 'no_gold_reference,low_dtw_with_strong_anchor_agreement' ELSE 'no_gold_reference' END WHEN few THEN 'insufficient_comparable_coverage' ELSE names END AS evidence,
  CASE WHEN suspected THEN 'reference_mismatch_review' WHEN drops AND strong THEN 'timing_delta_clamped_review' WHEN drops THEN 'consider_lyrics_no_timing' WHEN lexical THEN 'review_dtw_lexical_matching' WHEN flag THEN 'timing_delta_clamped_review' ELSE 'none' END AS hint FROM o"""
)
def diagnoses(spark, d):
    """Evidence with weights and the hint that follows from it, for every part's made-up metrics."""
    rows, m = _metrics(spark, d)
    names = {
        "lines": "line_count", "words": "gold_comparable_word_count", "line_cov": "dtw_line_coverage", "word_cov": "dtw_word_coverage", "agree_cov": "agreement_coverage_ratio", "agree_sim": "agreement_text_similarity_mean",
        "agree_p95": "agreement_start_p95_abs_sec", "agree_bad": "agreement_bad_ratio", "low_conf": "low_confidence_ratio", "gold_cov": "gold_word_coverage_ratio", "gold_mean": "gold_start_mean_abs_sec", "gold_p95": "gold_start_p95_abs_sec",
    }
    known = rows.select("p_partkey", F.col("gold").alias("gold_available"), F.col("flag").alias("source_disagreement"), F.col("flag").alias("timing_delta_clamped"), *(m[k].alias(name) for k, name in names.items()))
    out = di.policy_hint(di.divergence(known))
    return out.select("p_partkey", "suspected", "score", "confidence", F.array_join("evidence", ",").alias("evidence"), "hint")


@query(
    """WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS tm, event_type FROM events), n AS (SELECT *, lead(tm) OVER w AS nt, lead(event_type) OVER w AS ne, lead(value) OVER w AS nv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id))
 SELECT event_id, round(abs(value - nv) + CASE WHEN ne <> event_type THEN 0.4 + 0.01 * abs(nt - tm) / 3600 ELSE 0 END + greatest(50 - value, 0) * 0.5 + abs(value / 100 - nv / 100) * 0.35, 6) AS cost FROM n WHERE nt IS NOT NULL"""
)
def match_costs(spark, d):
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    rows = points(spark, d).withColumns({"nt": F.lead("at").over(w), "ne": F.lead("event_type").over(w), "nv": F.lead("value").over(w)}).where("nt IS NOT NULL")
    gap = F.when(F.col("ne") != F.col("event_type"), (F.col("nt") - F.col("at")) / 3600)
    return rounded(rows.select("event_id", di.match_cost(F.col("value"), F.col("nv"), gap, F.lit(50.0), F.col("value") / 100 - F.col("nv") / 100).alias("cost")), 6)


def _entries(spark, d):
    """Events as rows on screen: an hour is a second, three lanes, the type is the text."""
    lane = (F.col("event_id") % 3 * 30).cast("double")
    rows = spans(spark, d)
    return rows.select("event_id", "user_id", F.concat_ws(" ", F.lit("we"), "event_type").alias("text"), (F.col("start") / 3600).alias("first"), (F.col("end") / 3600).alias("last"), lane.alias("y"), (F.col("value") * 2.5).alias("light"))


@query()
def merged_entries(spark, d):
    """Overlaps, fades and re-entries of each user's rows, merged one after the other."""
    steps = [partial(rp.merge_overlaps, lane=15.0), partial(rp.merge_fades, lane=15.0), partial(rp.merge_reentries, lane=15.0)]
    return rounded(rp.passes(_entries(spark, d), ["user_id"], steps, brightness="light").select("event_id", "first", "last"), 3)


@query()
def inferred_cycles(spark, d):
    """Rows that a steady cycle over two lanes lets expect."""
    long = _entries(spark, d).withColumn("last", F.col("first") + 24)
    return rounded(rp.passes(long, ["user_id"], [partial(rp.add_cycles, lane=15.0)]).where("inferred").select("event_id", "first", "last"), 3)


@query()
def repaired_inversions(spark, d):
    """Rows in order of id, neighbours swapped where times and texts say so."""
    rows = _entries(spark, d).withColumns({"sure": F.col("light") / 250, "quality": F.col("light") / 250})
    return rp.repair_inversions(rows, ["user_id"], "event_id", "first", "text", "quality", "sure").select("event_id", "new_place")


@query()
def trimmed_to_match(spark, d):
    """How many lines of each turn stand up to the last one that is like a line of the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")
    rows = table(spark, d, "conversations").select("conv_id", "turn", lines.alias("b")).withColumn("a", F.lag("b").over(w)).where("a IS NOT NULL")
    return rows.select("conv_id", "turn", F.size("b").alias("lines"), rp.last_match("b", "a").alias("last"))
