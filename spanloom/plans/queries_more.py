"""Queries for filters, rules, suppression, ranking with reasons, and order-dependent matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scoring as sc
from spanloom.operators import align as al
from spanloom.operators import entity as en
from spanloom.operators import joins as jn
from spanloom.operators import sequences as sq
from spanloom.operators import suppress as sp
from spanloom.operators import windows as wn
from spanloom.sources.tables import table

from .base import E, S, points, query, rounded, spans


@query("""SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring|brand#1\\b') AND len(list_intersect(string_split(p_name, ' '), ['red', 'blue', 'small'])) > 0 ORDER BY p_partkey LIMIT 50""")
def manifest_filter(spark, d):
    """Case-insensitive search, any of some tags, the first rows: the limit is the feature."""
    rows = table(spark, d, "part").where(F.concat_ws(" ", "p_name", "p_brand", "p_type").rlike(r"(?i)ring|brand#1\b"))
    rows = rows.where(F.arrays_overlap(F.split("p_name", " "), F.array(*[F.lit(t) for t in ("red", "blue", "small")])))
    return rows.orderBy("p_partkey").select("p_partkey").limit(50)


@query(
    f"""WITH {E} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM e WHERE event_type <> 'signup'"""
)
def carried_forward(spark, d):
    """Section heads set a value that the rows after them carry."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points(spark, d).where("event_type <> 'signup'").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("carried"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct, min(href) AS first FROM a GROUP BY 1""")
def page_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_distinct"), F.min("href").alias("first"))


@query(
    f"""WITH {S} SELECT s.event_id, CASE WHEN value < 1 THEN 'too short' WHEN event_type = 'signup' THEN 'no signal' WHEN event_type = 'error' AND value > 100 THEN 'outlier' END AS reason,
 NOT (1705000000 BETWEEN "start" - 3600 AND "end" + 3600) AS outside, CASE WHEN event_type IN ('view', 'click') THEN 'hit' WHEN starts_with(event_type, 'p') THEN 'stored' ELSE 'other' END AS bucket FROM s"""
)
def label_rules(spark, d):
    kind = F.col("event_type")
    reason = sc.first_reason((F.col("value") < 1, "too short"), (kind == "signup", "no signal"), ((kind == "error") & (F.col("value") > 100), "outlier"))
    outside = ~F.lit(1705000000).between(F.col("start") - 3600, F.col("end") + 3600)
    bucket = F.when(kind.isin("view", "click"), "hit").when(kind.startswith("p"), "stored").otherwise("other")
    return spans(spark, d).select("event_id", reason.alias("reason"), outside.alias("outside"), bucket.alias("bucket"))


@query(f"""WITH {S} SELECT event_id FROM s a WHERE NOT (value < 10 AND EXISTS (SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.value >= 80 AND abs(b."start" - a."start") <= 7200))""")
def short_fragments(spark, d):
    return sp.drop_explained(spans(spark, d), F.col("value") < 10, F.col("value") >= 80, ["user_id"], "event_id", 7200.0).select("event_id")


@query(
    f"""WITH {S}, h AS (SELECT DISTINCT a.event_id, a.user_id, a.event_type FROM s a JOIN s b ON a.user_id = b.user_id AND abs(a."start" - b."start") <= 14400 AND a.event_type = b.event_type AND a.value < 30 AND b.value >= 30),
 c AS (SELECT user_id, event_type FROM h GROUP BY 1, 2 HAVING count(*) >= 2) SELECT event_id FROM s WHERE event_id NOT IN (SELECT event_id FROM h JOIN c USING (user_id, event_type))"""
)
def repeated_shards(spark, d):
    rows = spans(spark, d)
    return sp.repeated_shards(rows, F.col("value") < 30, ["user_id"], "event_type", "event_id", 2, 14400.0, F.col("a.event_type") == F.col("b.event_type")).select("event_id")


@query(
    """WITH b AS (SELECT l_suppkey, l_partkey % 10 AS k FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 12) SELECT l_suppkey, count(*) AS n FROM lineitem l WHERE NOT (l_quantity < 10 AND EXISTS (SELECT 1 FROM b WHERE b.l_suppkey = l.l_suppkey AND b.k = l.l_partkey % 10)) GROUP BY 1"""
)
def banned_keys(spark, d):
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 10)
    return sp.ban_frequent(rows, ["l_suppkey", "k"], "l_orderkey", 12, F.col("l_quantity") < 10).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT l_partkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) // 7 AS frame, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT *, lead(frame) OVER w AS nf, lead(v) OVER w AS nv FROM f WINDOW w AS (PARTITION BY l_partkey ORDER BY frame))
 SELECT l_partkey, frame + 1 AS frame, round((v + nv) / 2, 6) AS v FROM g WHERE nf = frame + 2"""
)
def filled_frames(spark, d):
    """Single weeks between two in which a part was shipped, over all lineitem rows."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")) / 7)
    rows = table(spark, d, "lineitem").groupBy("l_partkey", week.alias("frame")).agg(F.avg("l_quantity").alias("v"))
    return rounded(sp.fill_gaps_of_one(rows, ["l_partkey"], "frame", "v"), 6)


@query(
    """WITH f AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS frame, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT *, lead(frame) OVER w AS nf, lead(v) OVER w AS nv FROM f WINDOW w AS (PARTITION BY l_suppkey ORDER BY frame))
 SELECT l_suppkey, (frame + 1)::INTEGER AS frame, round((v + nv) / 2, 6) AS v FROM g WHERE nf = frame + 2"""
)
def filled_ship_days(spark, d):
    """Single days between two ship days of a supplier, over all lineitem rows."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", day.alias("frame")).agg(F.avg("l_quantity").alias("v"))
    return rounded(sp.fill_gaps_of_one(rows, ["l_suppkey"], "frame", "v"), 6)


@query(
    """WITH m AS (SELECT p_partkey, p_brand, p_size, p_retailprice, (p_size > 25)::INT + (p_retailprice > 1200)::INT * 2 AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, abs(p_size - 20), p_partkey) AS k FROM m)
 SELECT p_brand, p_partkey, score, (p_size > 25 AND p_retailprice > 1200) AS suitable FROM r WHERE k = 1"""
)
def best_source(spark, d):
    score = (F.col("p_size") > 25).cast("int") + (F.col("p_retailprice") > 1200).cast("int") * 2
    rows = table(spark, d, "part").withColumn("score", score)
    out = wn.top_n(rows, ["p_brand"], [F.desc("score"), F.abs(F.col("p_size") - 20), "p_partkey"], 1)
    return out.select("p_brand", "p_partkey", "score", ((F.col("p_size") > 25) & (F.col("p_retailprice") > 1200)).alias("suitable"))


@query(
    """WITH m AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
 s AS (SELECT c_custkey, greatest(0, 1 - n / 10) * 0.5 + CASE WHEN c_acctbal < 1000 THEN 0.3 ELSE 0 END + CASE WHEN top > 450000 THEN 0.4 ELSE 0 END AS score,
  concat_ws(',', CASE WHEN n < 10 THEN 'few' END, CASE WHEN c_acctbal < 1000 THEN 'low' END, CASE WHEN top > 450000 THEN 'big' END) AS reasons FROM m)
 SELECT c_custkey, round(score, 6) AS score, reasons FROM s WHERE score > 0.25 ORDER BY round(score, 6) DESC, c_custkey LIMIT 20"""
)
def triage_with_reasons(spark, d):
    """A ranked report of its first rows: the limit is the feature."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    m = table(spark, d, "customer").join(o, "c_custkey", "left").fillna({"n": 0, "top": 0.0})
    few, low, big = F.col("n") < 10, F.col("c_acctbal") < 1000, F.col("top") > 450000
    score = F.greatest(F.lit(0.0), 1 - F.col("n") / 10) * 0.5 + F.when(low, 0.3).otherwise(0) + F.when(big, 0.4).otherwise(0)
    out = m.withColumn("score", score).where("score > 0.25").select("c_custkey", F.round("score", 6).alias("score"), F.concat_ws(",", F.when(few, "few"), F.when(low, "low"), F.when(big, "big")).alias("reasons"))
    return out.orderBy(F.desc("score"), "c_custkey").limit(20)


@query(f"WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, round(value * 10), lower(trim(event_type)) ORDER BY tm, event_id) AS k FROM e) SELECT event_id FROM r WHERE k = 1")
def distinct_by_rounded_time(spark, d):
    return en.keep_first(points(spark, d), ["user_id", F.round(F.col("value") * 10), F.lower(F.trim("event_type"))], ["at", "event_id"]).select("event_id")


@query(
    """WITH s AS (SELECT c_custkey, s_suppkey, 0.55 * (c_nationkey = s_nationkey)::INT + 0.25 * greatest(0, 1 - abs(c_acctbal - s_acctbal) / 10000) + 0.2 * (c_custkey % 5 = s_suppkey % 5)::INT AS score, abs(c_acctbal - s_acctbal) AS gap
   FROM customer JOIN supplier ON c_nationkey = s_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(score, 9) DESC, gap, s_suppkey) AS k FROM s) SELECT c_custkey, s_suppkey, round(score, 8) AS score FROM r WHERE k = 1"""
)
def combined_score_match(spark, d):
    """For each customer the supplier of its nation with the best score. The score falls with the gap between balances, and
    rises if the keys' classes agree: so one of the nearest of the class or of the nation is the best, and as-of joins
    find these without forming the nation's pairs."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nat"), (F.col("c_custkey") % 5).alias("cls"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nat"), (F.col("s_suppkey") % 5).alias("cls"), F.col("s_acctbal").alias("bal"))
    near = [jn.as_of(c, s.select(*keys, "bal", "s_suppkey"), keys, "bal", "s_suppkey", way) for keys in (["nat"], ["nat", "cls"]) for way in ("backward", "forward")]
    pairs = reduce(DataFrame.unionByName, near).where("s_suppkey IS NOT NULL").withColumn("gap", F.abs(F.col("bal") - F.col("s_suppkey_at")))
    score = 0.55 + 0.25 * F.greatest(F.lit(0.0), 1 - F.col("gap") / 10000) + 0.2 * (F.col("cls") == F.col("s_suppkey") % 5).cast("int")
    best = wn.top_n(pairs.withColumn("score", score), ["c_custkey"], [F.round("score", 9).desc(), "gap", "s_suppkey"], 1)
    return rounded(best.select("c_custkey", "s_suppkey", "score"), 8)


@query("""SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red']) AND NOT list_has_any(string_split(p_name, ' '), ['bolt', 'gear'])""")
def identity_match(spark, d):
    words = F.split("p_name", " ")
    wanted, barred = F.array(F.lit("red")), F.array(F.lit("bolt"), F.lit("gear"))
    return table(spark, d, "part").where((F.size(F.array_except(wanted, words)) == 0) & ~F.arrays_overlap(words, barred)).select("p_partkey")


@query(f"WITH {E} SELECT event_id, (round_even(value / 2, 0) * 2) AS band, row_number() OVER (PARTITION BY user_id ORDER BY round_even(value / 2, 0), tm, event_id)::BIGINT AS place FROM e")
def quantised_order(spark, d):
    """Half-to-even quantising, then a second key."""
    w = Window.partitionBy("user_id").orderBy(F.bround(F.col("value") / 2, 0), "at", "event_id")
    return points(spark, d).select("event_id", (F.bround(F.col("value") / 2, 0) * 2).alias("band"), F.row_number().over(w).cast("long").alias("place"))


@query(
    """WITH b AS (SELECT avg(l_discount) AS d, avg(l_quantity) AS q FROM lineitem), c AS (SELECT l_suppkey, avg(l_discount) AS d, avg(l_quantity) AS q FROM lineitem GROUP BY 1)
 SELECT l_suppkey, round(c.d - b.d, 6) AS gain, round(c.q - b.q, 6) AS cost, (c.d - b.d >= 0.0005 AND c.q - b.q <= 0.5) AS passes FROM c, b"""
)
def trade_offs(spark, d):
    """Candidates against a baseline of one row."""
    rows = table(spark, d, "lineitem")
    measures = [F.avg("l_discount").alias("d"), F.avg("l_quantity").alias("q")]
    base = rows.agg(*measures).select(F.col("d").alias("bd"), F.col("q").alias("bq"))
    gain, cost = F.col("d") - F.col("bd"), F.col("q") - F.col("bq")
    out = rows.groupBy("l_suppkey").agg(*measures).join(F.broadcast(base))  # one row
    return rounded(out.select("l_suppkey", gain.alias("gain"), cost.alias("cost"), ((gain >= 0.0005) & (cost <= 0.5)).alias("passes")), 6)


@query(
    """WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4)) AS t FROM benchmark), p AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS n FROM w a JOIN w b ON a.t = b.t AND a.item_id < b.item_id GROUP BY 1, 2),
 s AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1) SELECT i, j, p.n AS shared, round(p.n / (x.n + y.n - p.n), 6) AS jaccard FROM p JOIN s x ON x.item_id = i JOIN s y ON y.item_id = j WHERE p.n >= 2"""
)
def blocked_text_pairs(spark, d):
    """Text pairs of a small reference table, blocked by shared tokens: no pair without one is formed."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 4))
    w = table(spark, d, "benchmark").select("item_id", F.size(words).alias("n"), F.explode(words).alias("t"))
    a, b = w.select(F.col("item_id").alias("i"), F.col("n").alias("ni"), "t"), w.select(F.col("item_id").alias("j"), F.col("n").alias("nj"), "t")
    pairs = a.join(b, "t").where("i < j").groupBy("i", "j", "ni", "nj").agg(F.count("*").alias("shared")).where("shared >= 2")
    return rounded(pairs.select("i", "j", "shared", (F.col("shared") / (F.col("ni") + F.col("nj") - F.col("shared"))).alias("jaccard")), 6)


def _turn_pairs(spark, d):
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    rows = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w"), F.split("text", "\n").alias("lines"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return rows.withColumns({"b": F.lag("w").over(w), "before": F.lag("lines").over(w)}).where("b IS NOT NULL")


@query()
def order_dependent_matches(spark, d):
    """Greedy line pairs, token matches, equal blocks, two-pointer lines and soft overlap of successive turns."""
    clock = lambda c: F.transform(F.col(c), lambda w, k: k.cast("double") * 0.4)
    rows = _turn_pairs(spark, d).withColumns({"g": sq.greedy_pairs("before", "lines"), "t": sq.token_matches("b", "w"), "e": sq.equal_blocks("b", "w"), "p": sq.two_pointer_lines("b", "w"), "x": clock("b"), "y": clock("w")})
    rows = rows.withColumns({"al": sq.aligned_words("b", "x", "w", "y"), "soft": sq.soft_overlap("b", "w")})
    return rounded(rows.select("conv_id", "turn", F.size("g").alias("lines"), F.size("t").alias("tokens"), F.size("e").alias("equal"), F.size("p").alias("ordered"), F.size("al").alias("aligned"), "soft"), 6)


@query()
def token_similarity_pairs(spark, d):
    """Similar tokens of a user's and an assistant's turns: all pairs that reach the ratio. Each distinct pair is compared once."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 6)))
    rows = table(spark, d, "conversations").select("conv_id", "role", words.alias("w"))
    a, b = (rows.where(F.col("role") == role).select("conv_id", F.col("w").alias(c)) for role, c in (("user", "a"), ("assistant", "b")))
    pairs = jn.similar_tokens(a, b, ["conv_id"], "a", "b", 0.8).select("a", "b").distinct().withColumn("similarity", al.similarity_from("a", "b", 0.8))
    return rounded(pairs.where("similarity IS NOT NULL"), 6)


@query(
    """WITH o AS (SELECT o_orderkey, o_totalprice, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT o_orderkey, n, round(least(o_totalprice / 1000, n * 50), 6) AS used FROM o"""
)
def capped_budgets(spark, d):
    """Running budgets: parts of 50 at most, together no more than a thousandth of the price."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_totalprice").agg(F.count("*").alias("n"))
    parts = sq.capped_durations(F.array_repeat(F.lit(50.0), F.col("n").cast("int")), F.col("o_totalprice") / 1000, 50.0)
    return rounded(o.select("o_orderkey", "n", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("used")), 6)


@query(
    f"""WITH {S}, n AS (SELECT *, lead(event_type) OVER w AS nt, lead("start") OVER w AS ns FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id))
 SELECT event_id, CASE WHEN nt IS NULL THEN 'last' WHEN ns < "end" AND nt = event_type THEN 'merged' WHEN ns < "end" THEN 'crossed' WHEN ns - "end" > 86400 THEN 'far' ELSE 'near' END AS effect, round(ns - "end", 3) AS signed_gap FROM n"""
)
def gap_effects(spark, d):
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    rows = spans(spark, d).withColumns({"nt": F.lead("event_type").over(w), "ns": F.lead("start").over(w)})
    gap = F.col("ns") - F.col("end")
    effect = sc.first_reason((F.col("nt").isNull(), "last"), ((gap < 0) & (F.col("nt") == F.col("event_type")), "merged"), (gap < 0, "crossed"), (gap > 86400, "far"), (F.lit(True), "near"))
    return rounded(rows.select("event_id", effect.alias("effect"), gap.alias("signed_gap")), 3)
