"""Queries over texts: normalisation, predicates, parsing, matching and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import nested as ns
from spanloom.functions import phonetic as ph
from spanloom.functions import text as tx
from spanloom.operators import align as al
from spanloom.operators import entity as en
from spanloom.operators import joins as jn
from spanloom.sources import lrc
from spanloom.sources.tables import table

from .base import E, S, points, query, rounded, spans


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), '-', ' '), '[^a-z0-9'' ]+', '', 'g'), ' ')) AS basic,
 md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[^a-z0-9'']+', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS line,
 md5(replace(replace(replace(replace(replace(replace(text, 'a', ''), 'e', ''), 'i', ''), 'o', ''), 'u', ''), 'y', '')) AS skeleton FROM documents"""
)
def normalised_texts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(tx.basic(t).cast("binary")).alias("basic"), F.md5(tx.line(t).cast("binary")).alias("line"), F.md5(tx.skeleton(t).cast("binary")).alias("skeleton"))


@query(r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), p_partkey::VARCHAR) AS slug FROM part""")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_partkey").cast("string")).alias("slug"))


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'la', 'der')), ' ')) AS title FROM documents""")
def titles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.title(F.col("text"), ["the", "of", "la", "der"]).cast("binary")).alias("title"))


@query(
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '(?i)^https?://|^http://', '') AS u FROM pages) SELECT page_id, CASE WHEN starts_with(lower(u), 'm.') THEN regexp_replace(u[3:], '^[\s\-:–]+', '') ELSE u END AS bare FROM u"""
)
def stripped_prefix(spark, d):
    u = tx.clean_title(F.col("url"), [r"^https?://|^http://"], [])
    return table(spark, d, "pages").select("page_id", tx.strip_leading(u, F.lit("m.")).alias("bare"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), ''), md5(url)[1:11]) AS id FROM pages""")
def url_ids(spark, d):
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.coalesce(part("[?&]ref=([^&#]*)"), part(r"/([0-9]+)(?:[?#]|$)"), F.substring(F.md5(F.col("url").cast("binary")), 1, 11)).alias("id"))


WORDS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> '')"


@query(
    rf"""WITH t AS (SELECT conv_id, turn, {WORDS.format("text")} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
 SELECT conv_id, turn, round(CASE WHEN least(len(list_distinct(w)), len(list_distinct(b))) > 0 THEN len(list_intersect(w, b)) / least(len(list_distinct(w)), len(list_distinct(b))) ELSE 0 END, 6) AS overlap FROM p WHERE b IS NOT NULL"""
)
def token_overlap(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w"))
    rows = rows.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return rounded(rows.select("conv_id", "turn", tx.overlap_coefficient(F.col("w"), F.col("b")).alias("overlap")), 6)


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
 SELECT doc_id, count(*) FILTER (regexp_full_match(line, '[\s♪🎵🎶♫♬\-–—=_.·•]*')) AS symbols,
 count(*) FILTER (regexp_matches(lower(line), 'https?://|www\.|@\w|\bmp3\b|\bsms\b|\bdownload\b|\bsubscribe\b|\bmember\b|\bring ?tone\b|\bmobile\b|\bphone\b|\btext\b') OR regexp_matches(line, '\+?[0-9][0-9\s().-]{4,}[0-9]')) AS promo,
 count(*) FILTER (regexp_matches(trim(line, ' '), '^[\p{L}\p{N}_]+\s*:\s*[A-Z][a-z]+(\s+[A-Z][a-z]+)*\s*$') AND length(regexp_extract(trim(line, ' '), '^([\p{L}\p{N}_]+)\s*:', 1)) <= 15) AS credit FROM l GROUP BY 1"""
)
def line_predicates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    c = F.col("line")
    return rows.groupBy("doc_id").agg(F.count_if(tx.is_symbols_only(c)).alias("symbols"), F.count_if(tx.is_promo(c)).alias("promo"), F.count_if(tx.has_credit(c)).alias("credit"))


@query(
    r"""WITH w AS (SELECT item_id, regexp_split_to_array(trim(text), '\s+') AS w, trim(text) AS t FROM benchmark)
 SELECT item_id, array_to_string(w[1:len(w) // 2], ' ') AS first_half, len(w) - 1 AS n_splits FROM w WHERE length(t) > 45 AND len(w) > 1"""
)
def long_line_splits(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", tx.split_long(F.col("text")).alias("parts"), tx.prefix_splits(F.col("text")).alias("splits")).where(F.size("parts") > 1)
    return rows.select("item_id", F.col("parts")[0].alias("first_half"), F.size("splits").cast("long").alias("n_splits"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)
 SELECT doc_id, len(w) AS n, list_filter(w, lambda x: length(x) >= 6)[1] AS first_long, contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AS has_phrase,
 round(CASE WHEN len(list_filter(w, lambda x: length(x) >= 2)) > 0 THEN len(list_filter(w, lambda x: length(x) >= 2 AND x IN ('the', 'of', 'and', 'le', 'der'))) / len(list_filter(w, lambda x: length(x) >= 2)) ELSE 0 END, 6) AS hits FROM w"""
)
def token_features(spark, d):
    w = F.col("w")
    rows = table(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("w"))
    bag = F.array(*[F.lit(x) for x in ("the", "of", "and", "le", "der")])
    out = rows.select("doc_id", F.size(w).cast("long").alias("n"), ns.first_content_token(w, 6).alias("first_long"), tx.is_subphrase(F.array(F.lit("of"), F.lit("the")), w).alias("has_phrase"), tx.hit_ratio(w, bag).alias("hits"))
    return rounded(out, 6)


@query(
    r"""WITH l AS (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS ls FROM conversations), w AS (SELECT conv_id, turn, i, list_filter(regexp_split_to_array(ls[i + 1], '\s+'), lambda x: x <> '') AS ws FROM l)
 SELECT conv_id, turn, count(*) FILTER (len(ws) > 0) AS lines, sum(len(ws))::BIGINT AS words FROM w GROUP BY 1, 2 HAVING sum(len(ws)) > 0"""
)
def unnested_words(spark, d):
    rows = ns.unnest_words(table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return rows.groupBy("conv_id", "turn").agg(F.count_distinct("line_idx").alias("lines"), F.count("*").alias("words"))


LRC = """f AS (SELECT user_id, string_agg('[' || (event_id % 60) || ':' || lpad((floor(value)::BIGINT % 75)::VARCHAR, 2, '0') || '.' || (event_id % 100) || '] ' || event_type, chr(10) ORDER BY event_id) AS text FROM events GROUP BY 1)"""


def _lyrics(spark, d):
    """Lyric files made of events: a line per event."""
    stamp = F.concat(F.lit("["), (F.col("event_id") % 60).cast("string"), F.lit(":"), F.lpad((F.floor("value") % 75).cast("string"), 2, "0"), F.lit("."), (F.col("event_id") % 100).cast("string"), F.lit("] "), "event_type")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", stamp.alias("t")))).alias("x"))
    return rows.select("user_id", F.array_join(F.transform("x", lambda v: v["t"]), "\n").alias("text"))


@query(
    rf"""WITH {LRC}, l AS (SELECT user_id, unnest(string_split(text, chr(10))) AS raw FROM f),
 s AS (SELECT user_id, CASE WHEN regexp_extract(raw, '\[(\d+):(\d+)\.(\d+)\]', 2)::INT < 60 THEN regexp_extract(raw, '\[(\d+):(\d+)\.(\d+)\]', 1)::DOUBLE * 60 + regexp_extract(raw, '\[(\d+):(\d+)\.(\d+)\]', 2)::DOUBLE
   + regexp_extract(raw, '\[(\d+):(\d+)\.(\d+)\]', 3)::DOUBLE / pow(10.0, length(regexp_extract(raw, '\[(\d+):(\d+)\.(\d+)\]', 3))) END AS st FROM l),
 a AS (SELECT user_id, count(*) AS n, min(st) AS first, max(st) AS last FROM s WHERE st IS NOT NULL GROUP BY 1)
 SELECT user_id, n, round(first, 3) AS first, round(last, 3) AS last, round(last + greatest(3, least(6, floor((last - first) * 0.1))), 3) AS duration, CASE WHEN n < 5 THEN 'too few lines' WHEN last - first < 30 THEN 'too short' END AS reason FROM a"""
)
def lyric_durations(spark, d):
    return rounded(lrc.durations(lrc.scan(_lyrics(spark, d), "user_id", "text"), "user_id"), 3)


@query(
    r"""WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS token FROM conversations WHERE role = 'user'),
 b AS (SELECT DISTINCT conv_id, turn AS bag, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS token FROM conversations WHERE role = 'assistant'),
 n AS (SELECT conv_id, turn, count(*) AS n FROM t GROUP BY 1, 2), h AS (SELECT t.conv_id, t.turn, bag, count(*) AS hits FROM t JOIN b USING (conv_id, token) GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, bag) AS r FROM h)
 SELECT n.conv_id, n.turn, round(coalesce(hits / n, 0), 6) AS share, max(coalesce(bag, 0)) OVER (PARTITION BY n.conv_id ORDER BY n.turn ROWS UNBOUNDED PRECEDING) AS assigned FROM n LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON k.conv_id = n.conv_id AND k.turn = n.turn"""
)
def overlap_assignment(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("token"))
    lines, bags = rows.where("role = 'user'").drop("role"), rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("bag"), "token")
    return rounded(jn.assign_by_overlap(lines, bags, ["conv_id"], "turn", "bag", "token"), 6)


@query()
def matched_texts(spark, d):
    """Canonical and accent-free forms; Spark has no Unicode normal forms, so these are pandas functions."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.canonical("text").cast("binary")).alias("canonical"), F.md5(tx.matching("text").cast("binary")).alias("matching"))


def _pairs(spark, d):
    """Successive turns of a conversation as token arrays."""
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return rows.withColumns({"b": F.lag("w").over(w), "before": F.lag("text").over(w)}).where("b IS NOT NULL")


@query()
def turn_alignment(spark, d):
    """Token warping, matching-block F1 and longest common run of successive turns."""
    rows = _pairs(spark, d).withColumns({"warp": al.token_warp("b", "w", None), "f": al.token_f1("b", "w"), "run": al.longest_common_run("b", "w")})
    out = rows.select("conv_id", "turn", "warp.n_path", "warp.total", "warp.matched", F.col("f.f1").alias("f1"), "run", al.overlap_suffix_prefix(F.col("b"), F.col("w")).alias("joined"))
    return rounded(out, 6)


@query(
    f"""WITH RECURSIVE {S}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "start", "end") AS rn FROM s),
 w AS (SELECT user_id, rn, event_id, "start", "end", event_type AS kept, "end" AS reach, true AS ok FROM n WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, "start", "end", CASE WHEN r THEN kept ELSE event_type END, CASE WHEN r THEN reach ELSE "end" END, NOT r FROM (SELECT n.*, w.kept, w.reach, (n.event_type = w.kept AND n."start" - w.reach <= 3600) AS r FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1)),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "start", "end") AS kn FROM w WHERE ok),
 p AS (SELECT user_id, kn, event_id, "start" AS a, "start" + greatest(0.2, "end" - "start") AS b FROM k WHERE kn = 1
  UNION ALL SELECT user_id, kn, event_id, a, a + greatest(0.2, "end" - "start") FROM (SELECT k.*, greatest(k."start", p.b + 0.02) AS a FROM p JOIN k ON k.user_id = p.user_id AND k.kn = p.kn + 1))
 SELECT event_id, user_id, round(a, 3) AS new_start, round(b, 3) AS new_end FROM p"""
)
def kept_after_repeats(spark, d):
    """Sequential passes over each user's rows: repeats by timing dropped, leaders clustered, overlaps pushed apart."""
    rows = spans(spark, d).select("event_id", "user_id", "event_type", "start", "end")
    kept = en.drop_adjacent_repeats(rows, ["user_id"], "start", "end", "event_type", 3600.0)
    pushed = en.push_overlaps(kept, ["user_id"], "start", "end", 0.02, 0.2)
    return rounded(pushed.select("event_id", "user_id", "new_start", "new_end"), 3)


@query(
    f"""WITH RECURSIVE {E}, n AS (SELECT event_id, user_id, tm, value, row_number() OVER (PARTITION BY user_id ORDER BY tm, value) AS rn FROM e),
 w AS (SELECT user_id, rn, event_id, [{{'t': tm, 'v': value}}] AS leaders, 0 AS cluster FROM n WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN k IS NULL THEN list_append(leaders, {{'t': tm, 'v': value}}) ELSE leaders END, coalesce(k - 1, len(leaders))::INTEGER
   FROM (SELECT n.*, w.leaders, nullif(list_position(list_transform(w.leaders, lambda x: abs(n.tm - x.t) <= 86400 AND abs(n.value - x.v) <= 20), true), 0) AS k FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1))
 SELECT event_id, cluster FROM w"""
)
def leader_clusters(spark, d):
    """Greedy leader clusters of a user's events by time and value."""
    rows = points(spark, d).select("event_id", "user_id", "at", "value")
    return en.leader_clusters(rows, ["user_id"], "at", "value", 86400.0, 20.0).select("event_id", "cluster")


SPOKEN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (ph.ALIKE | ph.CONTRACTIONS).items()) + "}"


@query(
    rf"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w, {SPOKEN} AS m FROM conversations)
 SELECT conv_id, turn, md5(array_to_string(list_transform(w, lambda x: coalesce(m[x], x)), ' ')) AS form FROM w"""
)
def spoken_forms(spark, d):
    """Each turn's text as it is compared by sound."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(ph.spoken_form(F.col("text")).cast("binary")).alias("form"))


@query()
def spoken_pairs(spark, d):
    """How alike the names and types of parts sound."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    score = ph.spoken_similarity(F.col("p_name"), F.col("p_type"))
    return rounded(rows.select("p_partkey", score.alias("score"), ph.with_skeletons(score, F.col("p_name"), F.col("p_type")).alias("best")), 6)
