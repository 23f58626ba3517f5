"""Queries for rule functions and sequential passes."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import policies as po
from spanloom.functions import rules as ru
from spanloom.functions.nested import bound
from spanloom.functions.text import syllables
from spanloom.operators import align as al
from spanloom.operators import sequences as sq
from spanloom.operators import tracking as tr
from spanloom.sources.tables import table

from .base import S, points, query, rounded, spans

#: The intervals of each user, numbered in order, with the start of the next.
N = S + """, n AS (SELECT *, row_number() OVER w AS rn, lead("start") OVER w AS nxt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end"))"""


ANY_PREFIX, ANY_PART = ("|".join(map(re.escape, x)) for x in (ru.PREFIXES, ru.SECTIONS))
#: The predicates in SQL, over ``line``.
BLANK = r"regexp_full_match(line, '[\s♪🎵🎶♫♬\-–—=_.·•]*')"
PROMO = r"""(regexp_matches(lower(line), 'https?://|www\.|@\w|\bmp3\b|\bsms\b|\bdownload\b|\bsubscribe\b|\bmember\b|\bring ?tone\b|\bmobile\b|\bphone\b|\btext\b') OR regexp_matches(line, '\+?[0-9][0-9\s().-]{4,}[0-9]'))"""
CREDITED = r"""(regexp_matches(trim(line, ' '), '^[\p{L}\p{N}_]+\s*:\s*[A-Z][a-z]+(\s+[A-Z][a-z]+)*\s*$') AND length(regexp_extract(trim(line, ' '), '^([\p{L}\p{N}_]+)\s*:', 1)) <= 15)"""
TITLE = "Released under the MIT License."


@query(
    r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS ls, source FROM documents), x AS (SELECT doc_id, i, ls[i + 1] AS line, source FROM l),
 b AS (SELECT *, regexp_replace(lower(line), '[ ''()]', '', 'g') AS bare, 'releasedunderthemitlicense.' AS title, regexp_replace(lower(source), '[ ''()]', '', 'g') AS artist, replace(lower(line), ' ', '') AS x2, lower(line) AS low FROM x),
 t AS (SELECT *, (len(string_split(low, 'released under the mit license.')) > 2 OR len(string_split(low, 'released under the mit license.')) = 2 AND NOT starts_with(regexp_replace(low, '^[ "''“”‘’(]+', ''), 'released under the mit license.')
   AND (regexp_matches(trim(line, ' '), '[.!?]$') OR regexp_matches(string_split(low, 'released under the mit license.')[1], '["“”]') AND regexp_matches(string_split(low, 'released under the mit license.')[2], '["“”]')) AND length(low) >= 39) AS advertises FROM b)
 SELECT doc_id, count(*) FILTER (BLANK OR regexp_matches(lower(trim(line, ' ')), '^(ANY_PREFIX)') OR regexp_matches(line, '(?i)\b(ANY_KEYWORD)\s*:\s*[a-z]') OR regexp_matches(lower(line), 'ANY_PART') OR CREDITED
  OR (i <= 1 AND (bare = title OR contains(bare, title) AND length(bare) < length(title) + 10 OR bare = title || artist OR bare = artist || title))
  OR (i <= 1 AND source <> '' AND (contains(translate(x2, 'öü', 'ou'), translate(replace(lower(source), ' ', ''), 'öü', 'ou')) OR regexp_matches(translate(x2, 'öü', 'ou'), 'blueöystercult|blueoystercult|blueoyster|b\.o\.c|boc')))
  OR (i <= 12 AND PROMO) OR (i <= 15 AND advertises)) AS n_metadata FROM t GROUP BY 1""".replace("ANY_PREFIX", ANY_PREFIX).replace("ANY_PART", ANY_PART).replace("ANY_KEYWORD", "|".join(ru.KEYWORDS)).replace("BLANK", BLANK).replace("CREDITED", CREDITED).replace("PROMO", PROMO)
)
def metadata_lines(spark, d):
    """Lines of each document that are no lyrics, were the license its title and its source its artist; a line a second."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    flag = ru.is_metadata(F.col("line"), F.lit(TITLE), F.col("source"), F.col("i"))
    return rows.groupBy("doc_id").agg(F.count_if(flag).alias("n_metadata"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, lower(line) AS low FROM l),
 p AS (SELECT doc_id, regexp_matches(low, '(single|radio|album)\s*(edit|version)?') AND NOT (contains(low, 'radio') AND regexp_matches(low, 'radio\s*[0-9]|radio\s+session|bbc\s+radio|radio\s+show')) AS edit, regexp_matches(low, 'ANY_TERM') AS term, regexp_matches(low, 'ANY_SHOW') AS shown FROM n)
 SELECT doc_id, count(*) FILTER (NOT edit AND (term OR shown)) AS n_non_studio, count(*) FILTER (edit) AS n_edits FROM p GROUP BY 1""".replace("ANY_TERM", "|".join(ru.NON_STUDIO)).replace("ANY_SHOW", "|".join(ru.PERFORMANCES))
)
def non_studio_titles(spark, d):
    """Lines of each document that would be titles of versions made outside a studio, and of studio edits."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    low = F.lower("line")
    edit = low.rlike(ru.STUDIO_EDIT) & ~(F.contains(low, F.lit("radio")) & low.rlike("|".join(ru.RADIO_SHOWS)))
    return rows.groupBy("doc_id").agg(F.count_if(ru.is_non_studio(F.col("line"))).alias("n_non_studio"), F.count_if(edit).alias("n_edits"))


@query(
    """WITH m AS (SELECT user_id, count(*) AS n, avg((value > 30)::INT) AS cov, count(*) FILTER (value > 90) AS gaps, abs(avg(value) - 50) AS off, stddev_pop(value) / 100 AS spread, bool_or(event_type = 'signup') AS tried FROM events GROUP BY 1)
 SELECT user_id, CASE WHEN n < 2 THEN 20 ELSE greatest(0, 100 - CASE WHEN cov < 0.6 THEN 30 WHEN cov < 0.8 THEN 15 ELSE 0 END - CASE WHEN n / 10 < 1.5 THEN 20 WHEN n / 10 < 2 THEN 10 ELSE 0 END - CASE WHEN off <= 8 THEN 0 ELSE 20 END - CASE WHEN n < 10 THEN 15 ELSE 0 END - CASE WHEN gaps > 2 THEN 10 ELSE 0 END) END::DOUBLE AS quality,
 CASE WHEN off < 12 THEN 'duration_mismatch_not_severe' WHEN tried THEN 'likely_trailing_outro_padding' WHEN cov > 0.5 THEN 'severe_mismatch_with_audio_recovery' ELSE 'severe_mismatch_without_audio_recovery' END AS reason,
 NOT tried AND n >= 25 AND cov BETWEEN 0.78 AND 0.88 AND cov BETWEEN 0.8 AND 0.92 AND spread >= 0.35 AS retry,
 round(CASE WHEN user_id % 3 = 0 THEN cov ELSE spread * 0.6 + cov * 0.4 END, 6) AS score, CASE WHEN user_id % 3 = 0 THEN 'internal' ELSE 'blended' END AS mode,
 CASE WHEN off <= 8 THEN 'trust' WHEN tried THEN 'trust_start' WHEN cov > 0.5 THEN 'realign' ELSE 'reject' END AS trust,
 CASE WHEN cov < 0.4 THEN 'coverage' WHEN off / 10 > 1 THEN 'offset' WHEN spread > 0.6 THEN 'jitter' ELSE 'none' END AS failure FROM m"""
)
def policy_rules(spark, d):
    """Each user's events as lines of a song: what they are worth, alone and blended, whether their times are trusted, a second
    pass tried, and what fails first."""
    m = table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n_lines"), F.avg((F.col("value") > 30).cast("int")).alias("coverage"), F.count_if(F.col("value") > 90).alias("large_gaps"), F.abs(F.avg("value") - 50).alias("mismatch"),
        (F.stddev_pop("value") / 100).alias("phonetic_similarity_coverage"), F.bool_or(F.col("event_type") == "signup").alias("tried"),
    )
    known = m.withColumns({"density": F.col("n_lines") / 10, "duration_match": F.coalesce(F.col("mismatch") <= 8, F.lit(False)), "padding": F.col("tried"), "recoverable": F.col("coverage") > 0.5, "line_count": F.col("n_lines"), "matched_ratio": F.col("coverage"), "line_coverage": F.col("coverage")})
    out = po.should_retry(po.trust_policy(po.lyric_quality(known)))
    coverage, mismatch, spread = (F.col(c) for c in ("coverage", "mismatch", "phonetic_similarity_coverage"))
    alone = F.col("user_id") % 3 == 0
    more = {
        "score": F.when(alone, coverage).otherwise(spread * 0.6 + coverage * 0.4),
        "mode": F.when(alone, "internal").otherwise("blended"),
        "trust": F.when(mismatch <= 8, "trust").when(F.col("tried"), "trust_start").when(coverage > 0.5, "realign").otherwise("reject"),
        "failure": F.when(coverage < 0.4, "coverage").when(mismatch / 10 > 1, "offset").when(spread > 0.6, "jitter").otherwise("none"),
    }
    return rounded(out.select("user_id", "quality", "reason", "retry", *(c.alias(name) for name, c in more.items())), 6)


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, source FROM documents), b AS (SELECT doc_id, regexp_replace(replace(lower(line || CASE doc_id % 5 WHEN 0 THEN ' Karafun Karaoke' WHEN 1 THEN ' www.' || source || '.com (c) xorafun' WHEN 2 THEN ' all rights reserved' WHEN 3 THEN ' copyright global' ELSE '' END), '-', ' '), '[^a-z0-9'' ]+', '', 'g') AS t FROM l),
 w AS (SELECT doc_id, list_filter(list_transform(string_split(t, ' '), lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS w FROM b),
 c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, 'karaoke|karafun|entertainer|digitop|rights|reserved|copyright|produced|association|global|ltd|www|http'))) AS o, len(list_filter(w, lambda x: regexp_matches(x, '^(kara|xara|xora)') AND length(x) >= 5)) AS p,
   len(list_filter(w, lambda x: contains(x, 'www') OR ends_with(x, 'com') OR ends_with(x, 'couk') OR ends_with(x, 'net'))) AS a FROM w)
 SELECT doc_id, count(*) FILTER ((a >= 1 AND (o >= 1 OR p >= 1)) OR o >= 3 OR (p >= 2 AND n >= 2) OR (n >= 10 AND (o >= 2 OR p >= 2))) AS n_noise FROM c GROUP BY 1"""
)
def screen_noise(spark, d):
    """Lines of each document that name a provider or owner, with words of such lines behind them."""
    more = F.element_at(F.array(F.lit(" Karafun Karaoke"), F.concat(F.lit(" www."), "source", F.lit(".com (c) xorafun")), F.lit(" all rights reserved"), F.lit(" copyright global"), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"), more.alias("more"))
    return rows.groupBy("doc_id").agg(F.count_if(ru.is_screen_noise(F.concat("line", "more"))).alias("n_noise"))


FORMS = {"of": "out of", "the": "this one", "le": "la"}


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
 e AS (SELECT doc_id, flatten(list_transform(w, lambda x: string_split(CASE x WHEN 'of' THEN 'out of' WHEN 'the' THEN 'this one' WHEN 'le' THEN 'la' ELSE x END, ' '))) AS t FROM w),
 c AS (SELECT doc_id, t, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i > 1 AND t[i] IN ('one', 'la', 'and') AND t[i] = t[i - 1] THEN NULL ELSE t[i] END), lambda x: x IS NOT NULL) AS r FROM e),
 s AS (SELECT doc_id, t, r, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] IN ('this', 'one', 'la', 'and') THEN NULL ELSE i END), lambda x: x IS NOT NULL) AS k FROM c)
 SELECT doc_id, len(t) AS expanded, len(r) AS collapsed, md5(CASE WHEN len(k) > 0 THEN array_to_string(r[list_min(k):list_max(k)], ' ') ELSE '' END) AS stripped FROM s"""
)
def token_rules(spark, d):
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    t = table(spark, d, "documents").select("doc_id", bound(words, lambda w: ru.expanded_tokens(w, FORMS)).alias("t"))
    r = t.select("doc_id", F.size("t").cast("long").alias("expanded"), bound(F.col("t"), lambda x: ru.collapsed_runs(x, ("one", "la", "and"))).alias("r"))
    return r.select("doc_id", "expanded", F.size("r").cast("long").alias("collapsed"), F.md5(F.array_join(bound(F.col("r"), lambda x: ru.stripped_ends(x, ("this", "one", "la", "and"))), " ").cast("binary")).alias("stripped"))


@query(
    f"""WITH RECURSIVE {N}, w AS (SELECT user_id, rn, event_id, "start" AS first, "end" AS low, "start" AS late, 1 AS k, 0 AS block FROM n WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN j THEN first ELSE "start" END, CASE WHEN j THEN least(low, "end") ELSE "end" END, CASE WHEN j THEN greatest(late, "start") ELSE "start" END, CASE WHEN j THEN k + 1 ELSE 1 END, CASE WHEN j THEN block ELSE block + 1 END
   FROM (SELECT n.user_id, n.rn, n.event_id, n."start", n."end", first, low, late, k, block, (k < 6 AND n."start" - first <= 7200 AND least(low, n."end") - greatest(late, n."start") >= 600) AS j FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1))
 SELECT event_id, block FROM w"""
)
def visibility_blocks(spark, d):
    rows = spans(spark, d).select("event_id", "user_id", "start", "end")
    return tr.visibility_blocks(rows, ["user_id"], "start", "end", 7200.0, 600.0, 6).select("event_id", "block")


@query(
    f"""WITH RECURSIVE {N}, w AS (SELECT user_id, rn, event_id, "start" AS a, greatest(least("end", coalesce(nxt, "end")), "start" + 0.06) AS b FROM n WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, a, greatest(least("end", coalesce(nxt, "end")), a + 0.06) FROM (SELECT n.*, greatest(n."start", w.b) AS a FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1))
 SELECT event_id, round(a, 3) AS new_start, round(b, 3) AS new_end FROM w"""
)
def resolved_overlaps(spark, d):
    rows = spans(spark, d).select("event_id", "user_id", "start", "end")
    return rounded(tr.resolved_overlaps(rows, ["user_id"], "start", "end").select("event_id", "new_start", "new_end"), 3)


@query()
def weaker_repeats(spark, d):
    rows = points(spark, d).select("event_id", "user_id", "at", F.concat_ws(" ", F.lit("seen a"), "event_type").alias("text"), (F.col("value") / 100).alias("quality"))
    return tr.drop_weaker_repeats(rows, ["user_id"], "at", "text", "quality", reach=43200.0).select("event_id")


@query()
def timed_alignment(spark, d):
    """All words of successive turns with made-up times, a turn being a block: best assignment of each word and its cost."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", words.alias("b")).withColumn("a", F.lag("b").over(w)).where("a IS NOT NULL")
    clock = lambda c: F.transform(F.col(c), lambda x, k: k.cast("double") * 0.4)
    rows = rows.withColumn("x", F.explode(al.timed_warp("a", clock("a"), "b", clock("b"), None)))
    out = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.avg("x.cost").alias("mean_cost"), F.count_if(F.col("x.cost") < 0.3).alias("close"))
    return rounded(out, 6)


@query(
    """WITH x AS (SELECT doc_id, regexp_extract_all(lower(text), '[b-df-hj-np-tvwxz]*[aeiouy]|[b-df-hj-np-tvwxz]+') AS parts FROM documents)
 SELECT doc_id, len(parts) AS n_parts, md5(array_to_string(parts, '|')) AS parts_md5 FROM x"""
)
def syllable_parts(spark, d):
    r = table(spark, d, "documents").select("doc_id", syllables(F.col("text")).alias("parts"))
    return r.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.md5(F.array_join("parts", "|").cast("binary")).alias("parts_md5"))


def _order_words(spark, d):
    """Orders as lines, their items as words (start, end) in order; an order has a few items only."""
    start, end = F.col("l_linenumber").cast("double"), F.col("l_linenumber") + F.col("l_quantity") / 50
    items = table(spark, d, "lineitem").select("l_orderkey", F.struct(start.alias("start"), end.alias("end")).alias("word"), "l_discount", start.alias("low"), end.alias("high"))
    return items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("word")).alias("words"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("l_discount").alias("most"))


@query(
    """WITH w AS (SELECT l_orderkey, l_linenumber AS s, l_linenumber + l_quantity / 50 AS e, min(l_linenumber) OVER o AS low, 1 + max(l_discount) OVER o AS f FROM lineitem WINDOW o AS (PARTITION BY l_orderkey))
 SELECT l_orderkey, round(low + (s - low) * f, 6) AS new_start, round(low + (e - low) * f, 6) AS new_end FROM w"""
)
def retimed_words(spark, d):
    r = _order_words(spark, d).select("l_orderkey", F.explode(sq.retimed(F.col("words"), F.col("low"), 1 + F.col("most"))).alias("w"))
    return rounded(r.select("l_orderkey", F.col("w.start").alias("new_start"), F.col("w.end").alias("new_end")), 6)


@query(
    """WITH w AS (SELECT l_orderkey, l_linenumber AS s, l_linenumber + l_quantity / 50 AS e, count(*) OVER o AS n, min(l_linenumber) OVER o AS low, max(l_linenumber + l_quantity / 50) OVER o AS high FROM lineitem WINDOW o AS (PARTITION BY l_orderkey)),
 k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e) - 1 AS k, greatest(high - low, 0.2) / n AS slot FROM w)
 SELECT l_orderkey, round(low + k * slot, 6) AS new_start, round(low + k * slot + 0.9 * slot, 6) AS new_end FROM k"""
)
def reflowed_words(spark, d):
    r = _order_words(spark, d).select("l_orderkey", F.explode(sq.reflowed(F.col("words"), F.col("low"), F.col("high"))).alias("w"))
    return rounded(r.select("l_orderkey", F.col("w.start").alias("new_start"), F.col("w.end").alias("new_end")), 6)
