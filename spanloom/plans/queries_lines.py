"""Queries for lines against what was heard, states over time, and titles, singers and timed words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import lines as ln
from spanloom.functions import rules as ru
from spanloom.operators import timing as tm
from spanloom.sources.tables import table

from .base import E, of_type, points, query, rounded

#: Times of events in quarters of an hour, so that seconds' thresholds tell them apart.
Q = E + ", q AS (SELECT event_id, user_id, event_type, value, tm / 900 AS t FROM e)"
NEAREST = """l AS (SELECT * FROM q WHERE event_type = 'view'), o AS (SELECT DISTINCT user_id, t AS onset FROM q WHERE event_type = 'click'),
 p AS (SELECT l.*, onset, row_number() OVER (PARTITION BY event_id ORDER BY abs(onset - t), onset) AS k FROM l LEFT JOIN o USING (user_id)), d AS (SELECT *, onset - t AS delta FROM p WHERE k = 1),
 i AS (SELECT *, CASE WHEN abs(delta) > 0.3 THEN CASE WHEN delta > 0 THEN 'early_line' ELSE 'late_line' END END AS issue FROM d)"""


def _quarters(spark, d):
    return points(spark, d).select("event_id", "user_id", "event_type", "value", (F.col("at") / 900).alias("t"))


def _issues(spark, d):
    rows = _quarters(spark, d)
    return tm.start_issues(of_type(rows, "view"), of_type(rows, "click"), ["user_id"], "t")


@query(f"WITH {Q}, {NEAREST} SELECT event_id, round(delta, 4) AS delta, issue, CASE WHEN issue IS NOT NULL THEN CASE WHEN abs(delta) < 0.5 THEN 'minor' WHEN abs(delta) < 1 THEN 'moderate' ELSE 'severe' END END AS severity FROM i")
def start_issues(spark, d):
    return rounded(_issues(spark, d).select("event_id", "delta", "issue", "severity"))


@query(f"WITH {Q}, {NEAREST} SELECT user_id, count(*) AS n_lines, count(*) FILTER (abs(delta) <= 0.5) AS n_matched, count(issue) AS n_issues, round(100.0 * count(*) FILTER (abs(delta) <= 0.5) / count(*), 4)::DOUBLE AS score FROM i GROUP BY 1")
def start_scores(spark, d):
    return rounded(tm.start_score(_issues(spark, d), ["user_id"]))


@query(
    f"""WITH {Q}, l AS (SELECT user_id, t, t + value / 100 AS fin, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM q), v AS (SELECT user_id, min(t) AS vocal FROM q WHERE event_type <> 'signup' GROUP BY 1),
 s AS (SELECT user_id, event_id, t AS a, t + value / 20 AS b FROM q WHERE event_type = 'signup'), k AS (SELECT s.*, vocal, EXISTS (SELECT 1 FROM l WHERE l.user_id = s.user_id AND nxt IS NOT NULL AND fin <= a + 0.5 AND nxt >= b - 0.5) AS hit FROM s JOIN v USING (user_id) WHERE b - a >= 2 AND a >= vocal),
 g AS (SELECT user_id, count(*) FILTER (a > vocal) AS n, count(*) FILTER (hit) AS m FROM k GROUP BY 1)
 SELECT user_id, coalesce(n, 0) AS n_silences, CASE WHEN n > 0 THEN m ELSE 0 END AS n_matched, round(CASE WHEN n > 0 THEN 100.0 * m / n ELSE 100 END, 4)::DOUBLE AS score FROM (SELECT DISTINCT user_id FROM q) LEFT JOIN g USING (user_id)"""
)
def pause_scores(spark, d):
    """Signups are silences here, between the events of their user."""
    rows = _quarters(spark, d)
    vocal = rows.where("event_type <> 'signup'").groupBy("user_id").agg(F.min("t").alias("vocal"))
    silences = of_type(rows, "signup").select("user_id", "t", (F.col("t") + F.col("value") / 20).alias("fin")).join(vocal, "user_id")
    lines = rows.select("user_id", "t", (F.col("t") + F.col("value") / 100).alias("fin"))
    return rounded(tm.pause_score(lines, silences, ["user_id"], "t", "fin", "t", F.col("vocal")))


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM conversations), n AS (SELECT *, lead(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM t),
 a AS (SELECT conv_id, turn, ws, nx[i + 1] AS w, i FROM n, LATERAL (SELECT unnest(range(len(nx))) AS i))
 SELECT conv_id, turn, count(*) AS n_assigned, round(count(*) FILTER (list_contains(ws, w)) / count(*), 6) AS overlap, round(count(*) FILTER (w IN ('the', 'a')) / count(*), 6) AS placeholders, median(abs(i - len(ws)))::DOUBLE AS median_drift, max(abs(i - len(ws))) AS max_drift, count(DISTINCT i // 10) AS n_segments FROM a GROUP BY 1, 2"""
)
def assignment_profiles(spark, d):
    """The words of the next turn, assigned to each turn."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    turns = table(spark, d, "conversations").select("conv_id", "turn", words.alias("ws")).withColumn("nx", F.lead("ws").over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = turns.select("conv_id", "turn", "ws", F.posexplode("nx").alias("i", "w"))
    out = tm.assignment_profile(rows, ["conv_id", "turn"], F.col("w"), F.array_contains("ws", F.col("w")), F.col("w").isin("the", "a"), (F.col("i") - F.size("ws")).cast("long"), F.floor(F.col("i") / 10))
    return rounded(out, 6, "overlap", "placeholders")


@query(
    f"""WITH {Q}, l AS (SELECT * FROM q WHERE event_type = 'view'), o AS (SELECT user_id, t AS onset FROM q WHERE event_type = 'click'), p AS (SELECT l.*, (SELECT min(onset) FROM o WHERE o.user_id = l.user_id AND onset >= l.t) - t AS delta FROM l),
 m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY delta) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM p WHERE delta <= 48)
 SELECT user_id, count(*) AS n, round(avg(delta), 4) AS mean, round(max(CASE WHEN k = floor(0.95 * (n - 1)) + 1 THEN delta END), 4) AS p95, round(avg(delta) FILTER (value > 50), 4) AS mean_of_kind, round(avg(delta) FILTER (value <= 50), 4) AS mean_of_others FROM m GROUP BY 1"""
)
def onset_biases(spark, d):
    rows = _quarters(spark, d)
    return rounded(tm.onset_bias(of_type(rows, "view"), of_type(rows, "click"), ["user_id"], "t", 48.0, F.col("value") > 50))


@query(
    f"""WITH {Q}, v AS (SELECT *, value >= 40 AS vis, count(*) FILTER (value < 40) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS dim FROM q),
 h AS (SELECT *, vis AND count(*) FILTER (vis) OVER (PARTITION BY user_id, dim ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) >= 3 AS hit FROM v),
 b AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM h)
 SELECT user_id, round(min(t), 4) AS first_seen, round(max(t) FILTER (vis OR NOT before), 4) AS last_seen, round(CASE WHEN bool_or(hit) THEN greatest(min(t), min(t) FILTER (hit) - 0.2) END, 4) AS first_visible, count(*) AS n FROM b GROUP BY 1"""
)
def track_visibility(spark, d):
    return rounded(tm.visibility(_quarters(spark, d), ["user_id"], "t", ["event_id"], F.col("value") >= 40))


@query(
    f"""WITH {Q}, n AS (SELECT event_id, value, lag(value) OVER w AS y1, lag(value, 2) OVER w AS y2, lag(value, 3) OVER w AS y3 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 c AS (SELECT event_id, k, abs(value - [y1, y2, y3][k]) AS dy, 1 - abs(value - [y1, y2, y3][k]) / 60 AS sim FROM n, (SELECT unnest([1, 2, 3]) AS k)),
 s AS (SELECT event_id, k, sim * 0.7 + (1 - least(dy, 30) / 30) * 0.3 AS score FROM c WHERE dy <= 25 AND (sim > 0.6 OR (dy < 10 AND sim > 0.5)))
 SELECT event_id, k AS track, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, k) AS r FROM s) WHERE r = 1"""
)
def track_matches(spark, d):
    """The best of the three rows before, for each event of a user."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = _quarters(spark, d).withColumns({f"y{k}": F.lag("value", k).over(w) for k in (1, 2, 3)})
    pairs = rows.select("event_id", "value", F.posexplode(F.array("y1", "y2", "y3")).alias("k", "y")).withColumn("dy", F.abs(F.col("value") - F.col("y")))
    scored = pairs.withColumn("score", tm.track_match(F.col("dy"), 1 - F.col("dy") / 60)).where("score IS NOT NULL")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("event_id").orderBy(F.round("score", 9).desc(), "k"))).where("r = 1")
    return rounded(best.select("event_id", (F.col("k") + 1).alias("track"), "score"), 6)


@query(f"WITH {E}, n AS (SELECT *, lead(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) - tm AS s FROM e) SELECT user_id, event_type, round(sum(s), 3) AS seconds, count(*) AS n FROM n GROUP BY 1, 2")
def phase_seconds(spark, d):
    return rounded(tm.phase_seconds(points(spark, d), ["user_id"], "at", ["event_id"], "event_type"), 3)


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def best_suitable(spark, d):
    """The dearest part of each brand; an error if it costs less than one."""
    return tm.best_or_error(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], F.col("p_retailprice") >= 1).select("p_brand", "p_partkey", "p_retailprice")


@query(
    r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT *, regexp_extract(line, '^\s*(\w+)', 1) AS title FROM l)
 SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)\b(composer|lyricist|writer|arranger|producer|saku|sakkyoku|sakushi|henkyoku)\s*:\s*[a-z]')) AS keywords,
  count(*) FILTER (title <> '' AND (len(lower(line)) - len(replace(lower(line), lower(title), ''))) / len(title) >= 2) AS repeats FROM t GROUP BY 1"""
)
def title_repeats(spark, d):
    """Lines with credit words, and lines that repeat their own first word (which, in front, counts only when it repeats)."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    title = F.regexp_extract("line", r"^\s*([0-9A-Za-z_]+)", 1)
    return lines.groupBy("doc_id").agg(F.count_if(ru.has_keyword(F.col("line"))).alias("keywords"), F.count_if(ru.repeats_title(F.col("line"), title)).alias("repeats"))


@query(
    """SELECT c_custkey, CASE WHEN n LIKE '%&%' THEN 'both' WHEN n LIKE 'build%' OR starts_with('build', n) THEN 'singer1' WHEN n LIKE 'auto%' THEN 'singer2' ELSE 'singer1' END AS singer, s FROM (SELECT c_custkey, lower(c_mktsegment) || CASE WHEN c_nationkey = 3 THEN ' & co' ELSE '' END AS n,
 len(list_filter(list_transform(string_split(lower(c_mktsegment || '/household'), '/'), lambda x: trim(x)), lambda x: x NOT IN ('household', 'machinery'))) > 0 AS s FROM customer)"""
)
def singer_ids(spark, d):
    name = F.concat("c_mktsegment", F.when(F.col("c_nationkey") == 3, " & co").otherwise(""))
    lines = F.concat("c_mktsegment", F.lit("/household"))
    return table(spark, d, "customer").select("c_custkey", ln.singer_id(name, ["Build", "Auto"]).alias("singer"), ln.any_unknown_singer(lines, ["Household", "Machinery"]).alias("s"))


@query(
    """WITH w AS (SELECT conv_id, turn, i, string_split(text, ' ')[i + 1] AS word FROM (SELECT *, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations)), n AS (SELECT conv_id, turn, i, regexp_extract_all(lower(word), '[a-z0-9]+') AS ts FROM w WHERE i % 5 <> 4),
 x AS (SELECT conv_id, turn, unnest(ts) AS token, i / 4 AS start FROM n) SELECT conv_id, turn, token, count(*) AS n, round(min(start), 4) AS first_start FROM x GROUP BY 1, 2, 3"""
)
def window_tokens(spark, d):
    """Every fifth word of a turn has no start, and so no tokens."""
    word = lambda w, i: F.struct(w.alias("text"), F.when(i % 5 != 4, i / 4).alias("start"))
    tokens = ln.window_tokens(F.transform(F.split("text", " "), word), lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(tokens).alias("x")).select("conv_id", "turn", "x.*")
    return rounded(rows.groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"), F.min("start").alias("first_start")))


@query("""SELECT p_partkey, p_brand AS artist, p_name AS title, round(p_retailprice / 1.25, 4) AS slower FROM part""")
def title_parts(spark, d):
    """Artist and title out of titles as videos bear them."""
    said = F.concat("p_brand", F.lit(" - "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " (Official Video)").otherwise(" [Remastered] HD"))
    rows = table(spark, d, "part").withColumn("x", ln.title_parts(said))
    return rounded(rows.select("p_partkey", "x.artist", "x.title", ln.scaled(F.col("p_retailprice"), 1.25).alias("slower")))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\bc[*o]py(ing|ies)?\b', 'copy\1', 'g'), '(?i)\bl[*i]cen[cs]e(d|s)?\b', 'licence\1', 'g')) AS h FROM documents""")
def replaced_words(spark, d):
    text = ln.replaced(F.col("text"), [(r"(?i)\bc[*o]py(ing|ies)?\b", "copy"), (r"(?i)\bl[*i]cen[cs]e(d|s)?\b", "licence")])
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("h"))
