"""Queries over records with metrics: aggregation, comparison, rules, ranking, sets and deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import nested as ns
from spanloom.functions import scoring as sc
from spanloom.operators import aggregates as ag
from spanloom.operators import entity as en
from spanloom.operators import joins as jn
from spanloom.operators import windows as wn
from spanloom.sources.records import best_ranked
from spanloom.sources.tables import table

from .base import E, points, query, rounded

PHASES = "map('base', l_extendedprice, 'tax', l_extendedprice * l_tax, 'discount', l_extendedprice * l_discount)"


@query(
    """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS ratio, round(avg(l_quantity), 6) AS mean,
 round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, count(*) FILTER (l_discount = 0) AS n_zero FROM lineitem GROUP BY 1"""
)
def suite_aggregate(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"), ag.ratio_of_sums("l_tax", "l_discount").alias("ratio"), F.avg("l_quantity").alias("mean"),
        ag.weighted_mean("l_discount", "l_quantity").alias("weighted"), F.count_if(F.col("l_discount") == 0).alias("n_zero"),
    )
    return rounded(rounded(out, 6, "ratio", "mean", "weighted"), 2, "total")


@query(
    """SELECT o_orderpriority, round(coalesce(quantile_cont(o_totalprice, 0.95), 0), 4) AS linear, round(quantile_cont(o_totalprice, 0.94), 4) AS binned,
 list_sort(list(o_totalprice))[floor(0.95 * count(o_totalprice))::INT + 1] AS ranked FROM orders GROUP BY 1"""
)
def percentile_kinds(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderpriority").agg(ag.percentile("o_totalprice", 0.95).alias("linear"), ag.percentile_of_bins("o_totalprice", 0.95).alias("binned"), ag.percentile_nearest_rank("o_totalprice").alias("ranked"))
    return rounded(out, 4, "linear", "binned")


@query("""WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1) SELECT o_orderpriority, round(max(med), 4) AS "offset", round(avg(abs(o_totalprice - med)), 4) AS spread FROM orders JOIN m USING (o_orderpriority) GROUP BY 1""")
def offset_and_spread(spark, d):
    return rounded(ag.offset_and_spread(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"))


@query(
    """SELECT event_type, count(*) FILTER (abs(value - 50) <= 20) AS good, count(*) FILTER (abs(value - 50) > 20 AND abs(value - 50) <= 60) AS warn, count(*) FILTER (abs(value - 50) > 60) AS bad,
 count(*) FILTER (abs(value - 50) > 150) AS severe, round(CASE WHEN count(value) > 1 THEN stddev_pop(value) ELSE 0 END, 6) AS std FROM events GROUP BY 1"""
)
def bucket_counts(spark, d):
    rows = table(spark, d, "events").withColumn("delta", F.col("value") - 50)
    return rounded(rows.groupBy("event_type").agg(*ag.bucket_counts("delta", 20, 60, 150), ag.std_or_zero("value").alias("std")), 6)


@query(f"WITH {E}, c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1")
def mode_first_seen(spark, d):
    return ag.mode_first_seen(points(spark, d), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "n")


@query(
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey)::BIGINT AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c)
 SELECT o_custkey, o_orderpriority, n, total FROM r WHERE k = 1 AND n >= 2 AND n >= 0.4 * total"""
)
def consensus_share(spark, d):
    return ag.consensus(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", 2, 0.4).select("o_custkey", "o_orderpriority", "n", "total")


@query("""SELECT (floor(p_size / 5))::BIGINT AS bin, count(*) AS n, round(avg(p_size), 6) AS mean_x, round(avg(p_retailprice), 4) AS mean_y, round(var_pop(p_size), 4) AS var_x, round(var_pop(p_retailprice), 2) AS var_y FROM part GROUP BY 1""")
def moment_sketch(spark, d):
    rows = table(spark, d, "part").select(F.floor(F.col("p_size") / 5).alias("bin"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    out = ag.moments(rows, ["bin"], "x", "y")
    return rounded(rounded(rounded(out, 6, "mean_x"), 4, "mean_y", "var_x"), 2, "var_y")


@query("""SELECT l_linenumber::BIGINT AS lane, round(quantile_cont(l_quantity, 0.95) * 0.7, 6) AS threshold FROM lineitem GROUP BY 1 UNION ALL SELECT -1, round(quantile_cont(l_quantity, 0.95) * 0.7, 6) FROM lineitem""")
def lane_thresholds(spark, d):
    return rounded(ag.thresholds_with_default(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("lane"), "l_quantity"), "lane", "l_quantity", 0.95, 0.7, 150.0), 6)


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) AS counts FROM c GROUP BY 1""")
def counter_maps(spark, d):
    out = ag.counter_map(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority")
    return out.select("o_orderstatus", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query(
    """WITH t AS (SELECT 'base' AS key, sum(l_extendedprice) AS total FROM lineitem UNION ALL SELECT 'tax', sum(l_extendedprice * l_tax) FROM lineitem UNION ALL SELECT 'discount', sum(l_extendedprice * l_discount) FROM lineitem)
 SELECT key, round(total, 1) AS total, round(total / sum(total) OVER (), 6) AS share FROM t"""
)
def map_sums(spark, d):
    out = ag.map_sum(table(spark, d, "lineitem").select(F.expr(PHASES).alias("m")), "m")
    return rounded(rounded(out, 6, "share"), 1, "total")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) AS total, count(*) FILTER (o_orderstatus = 'F') / count(*) AS first_share FROM orders GROUP BY 1""")
def outcome_pivot(spark, d):
    return ag.outcome_pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part WHERE p_size >= 15) GROUP BY 1""")
def tag_counts(spark, d):
    return ag.tag_counts(table(spark, d, "part").withColumn("tags", F.split("p_name", " ")), "tags", F.col("p_size") >= 15)


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer) WHERE k <= 2""")
def repeat_capped(spark, d):
    return ag.repeat_capped(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], ["c_custkey"], 2).select("c_custkey")


def _yearly(spark, d, year: int):
    rows = table(spark, d, "lineitem").where(F.year("l_shipdate") == year)
    return rows.groupBy("l_suppkey").agg(F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))


DELTAS = """a AS (SELECT l_suppkey, avg(l_discount) AS discount, avg(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1),
 b AS (SELECT l_suppkey, avg(l_discount) AS discount, avg(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem WHERE year(l_shipdate) = 1999 GROUP BY 1),
 j AS (SELECT l_suppkey, 'discount' AS metric, a.discount AS x, b.discount AS y, -1 AS dir FROM a JOIN b USING (l_suppkey) UNION ALL SELECT l_suppkey, 'quantity', a.quantity, b.quantity, 1 FROM a JOIN b USING (l_suppkey)
  UNION ALL SELECT l_suppkey, 'tax', a.tax, b.tax, -1 FROM a JOIN b USING (l_suppkey))"""
METRICS = {"discount": -1, "quantity": 1, "tax": -1}


@query(f"WITH {DELTAS} SELECT l_suppkey, metric, round(x, 6) AS baseline, round(y, 6) AS corrected, round(y - x, 6) + 0.0 AS delta, CASE WHEN abs(y - x) >= 1e-6 THEN (y - x) * dir > 0 END AS improved FROM j")
def metric_deltas(spark, d):
    return rounded(ag.metric_deltas(_yearly(spark, d, 1998), _yearly(spark, d, 1999), ["l_suppkey"], METRICS, 1e-6), 6)


@query(f"WITH {DELTAS}, i AS (SELECT l_suppkey, CASE WHEN abs(y - x) >= 1e-6 THEN (y - x) * dir > 0 END AS up FROM j) SELECT l_suppkey, count(*) FILTER (up) AS improved_metrics, count(*) FILTER (NOT up) AS regressed_metrics, count(*) FILTER (up) - count(*) FILTER (NOT up) AS net_score FROM i GROUP BY 1")
def net_outcomes(spark, d):
    return ag.net_outcome(ag.metric_deltas(_yearly(spark, d, 1998), _yearly(spark, d, 1999), ["l_suppkey"], METRICS, 1e-6), ["l_suppkey"])


@query(
    """WITH m AS (SELECT unnest(['quantity', 'discount']) AS metric, unnest([avg(l_quantity), avg(l_discount)]) AS value FROM lineitem), r(rule, "limit") AS (VALUES ('min_quantity', 1000.0::DOUBLE), ('max_quantity', 1000.0), ('max_discount', 0.01), ('min_absent', 1.0))
 SELECT rule, "limit", round(value, 6) AS value, CASE WHEN value IS NULL THEN 'missing' ELSE 'violated' END AS status FROM r LEFT JOIN m ON metric = substr(rule, 5)
 WHERE value IS NULL OR (rule LIKE 'min%' AND value < "limit") OR (rule LIKE 'max%' AND value > "limit")"""
)
def threshold_rules(spark, d):
    m = table(spark, d, "lineitem").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    metrics = m.select(F.expr("stack(2, 'quantity', q, 'discount', d)").alias("metric", "value"))
    rules = spark.createDataFrame([("min_quantity", 1000.0), ("max_quantity", 1000.0), ("max_discount", 0.01), ("min_absent", 1.0)], "rule string, limit double")
    return rounded(ag.check_thresholds(metrics, rules), 6, "value")


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS base, l_extendedprice * l_tax AS tax, l_extendedprice * l_discount AS discount FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(base + tax + discount), 5) AS total, 'base' AS longest, round(sum(base) / sum(base + tax + discount), 4) AS share FROM x GROUP BY 1, 2, 3, 4 HAVING count(*) = 1"""
)
def runtime_profile(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # a key of one row has that row's values; no window sorts the rows for it
    values = [F.max(c).alias(c) for c in ("l_extendedprice", "l_tax", "l_discount")]
    rows = table(spark, d, "lineitem").groupBy(*keys).agg(F.count("*").alias("__n"), *values).where("__n = 1").select(*keys, F.expr(PHASES).alias("m"))
    out = ag.runtime_profile(rows, keys, "m").select(*keys, "total", "longest", "share")
    return rounded(rounded(out, 5, "total"), 4, "share")


@query(
    """WITH s AS (SELECT l_suppkey, year(l_shipdate) AS stage, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT *, v - lag(v) OVER (PARTITION BY l_suppkey ORDER BY stage) AS step FROM s)
 SELECT l_suppkey, min(stage) FILTER (abs(step) >= 0.5) AS first_changed, arg_min(stage, (-abs(step), stage)) FILTER (abs(step) >= 0.5) AS most_changed, round(arg_max(v, stage) - arg_min(v, stage), 6) AS total_change FROM t GROUP BY 1"""
)
def stage_effects(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("stage")).agg(F.avg("l_quantity").alias("v"))
    return rounded(ag.stage_effects(rows, ["l_suppkey"], "stage", "v", 0.5), 6)


VOTE = """w AS (SELECT source, unnest(range(len(string_split(text, ' ')))) AS place, unnest(string_split(text, ' ')) AS token FROM documents), v AS (SELECT source, place, token, count(*) AS votes FROM w WHERE token <> '' GROUP BY 1, 2, 3),
 r AS (SELECT *, votes / sum(votes) OVER (PARTITION BY source, place) AS share, row_number() OVER (PARTITION BY source, place ORDER BY votes DESC, length(token) DESC, token) AS k FROM v)"""


@query(f"WITH {VOTE} SELECT source, place, token, votes, round(share, 8) AS share FROM r WHERE k = 1")
def positional_vote(spark, d):
    """A vote of each source's documents at every place; positional_vote_everywhere holds one of each language's."""
    rows = ag.words_in_runs(table(spark, d, "documents"), ["source"], "text")
    return rounded(ag.positional_vote(rows, ["source", "run"], "place", "token", "token").drop("run"), 8)


EVERY_VOTE = """w AS (SELECT lang, unnest(range(len(string_split(text, ' ')))) AS place, unnest(string_split(text, ' ')) AS token FROM documents), v AS (SELECT lang, place, token, count(*) AS votes FROM w WHERE token <> '' GROUP BY 1, 2, 3),
 r AS (SELECT *, votes / sum(votes) OVER (PARTITION BY lang, place) AS share, row_number() OVER (PARTITION BY lang, place ORDER BY votes DESC, length(token) DESC, token) AS k FROM v)"""


@query(f"WITH {EVERY_VOTE} SELECT lang, place, token, votes, round(share, 8) AS share FROM r WHERE k = 1")
def positional_vote_everywhere(spark, d):
    """A vote of each language's documents at every place."""
    rows = ag.words_in_runs(table(spark, d, "documents"), ["lang"], "text")
    return rounded(ag.positional_vote(rows, ["lang", "run"], "place", "token", "token").drop("run"), 8)


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_orders(spark, d):
    rows = table(spark, d, "orders").withColumn("total", F.round("o_totalprice", 2))
    return wn.top_n(rows, ["o_custkey"], [F.col("total").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "total")


@query("SELECT l_suppkey, round(avg(l_discount), 4) AS ratio, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def hotspots(spark, d):
    """A top-k report: the limit is the feature."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 4).alias("ratio"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("ratio"), F.desc("n"), "l_suppkey").limit(10)


@query(
    """WITH m AS (SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n, spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey),
 s AS (SELECT c_custkey, CASE WHEN n = 0 THEN 1.0 WHEN n < 5 THEN 0.4 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 0.5 ELSE 0 END + greatest(0, least(1, coalesce(spent, 0) / 1e6)) AS score FROM m)
 SELECT c_custkey, round(score, 6) AS score, CASE WHEN score >= 1.2 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS band FROM s WHERE score > 0.25"""
)
def triage_scores(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("spent"))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.when(F.col("n") == 0, 1.0).when(F.col("n") < 5, 0.4).otherwise(0) + F.when(F.col("c_acctbal") < 0, 0.5).otherwise(0) + sc.clamp(F.coalesce("spent", F.lit(0.0)) / 1e6)
    return rounded(rows.withColumn("score", score).where("score > 0.25").select("c_custkey", "score", sc.band(F.col("score"), [(1.2, "high"), (0.8, "medium")], "low").alias("band")), 6)


@query(
    """SELECT p_partkey, round((coalesce(p_retailprice / 2000 * 0.6, 0) + p_size / 50 * 0.4) / 1.0, 6) AS quality, round(0.7 / (1 + p_size) + 0.3 / (1 + p_retailprice), 8) AS inverse,
 CASE WHEN abs(p_size - 25) <= 10 THEN 10 WHEN abs(p_size - 25) <= 20 THEN 5 ELSE 0 END AS bonus,
 CASE WHEN abs((p_size - 25) / 10) <= 0.3 THEN 0 WHEN abs((p_size - 25) / 10) <= 2 THEN (p_size - 25) / 10 ELSE 0 END::DOUBLE AS applied,
 CASE WHEN p_size < 5 THEN 'tiny' WHEN p_retailprice > 1500 THEN 'dear' WHEN p_type = 'ECONOMY' THEN 'economy' END AS reason FROM part"""
)
def policy_scores(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    out = table(spark, d, "part").select(
        "p_partkey", sc.weighted_score([(price / 2000, 0.6), (size / 50, 0.4)]).alias("quality"), sc.inverse_score([(size, 0.7), (price, 0.3)]).alias("inverse"), sc.duration_bonus(size - 25).alias("bonus"),
        sc.offset_policy((size - 25) / 10, most=2.0).alias("applied"), sc.first_reason((size < 5, "tiny"), (price > 1500, "dear"), (F.col("p_type") == "ECONOMY", "economy")).alias("reason"),
    )
    return rounded(rounded(out, 6, "quality"), 8, "inverse")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def common_keys(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'P'").select("k"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def keys_without_orders(spark, d):
    """Customers without urgent orders that are filled."""
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(orders.select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def semi_join_either_key(spark, d):
    keys = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).union(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k")))
    return table(spark, d, "customer").join(keys, F.col("k") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query(
    """WITH u AS (SELECT c_name AS name, c_acctbal AS bal, 1 AS prio, c_custkey AS k, c_nationkey AS nat FROM customer UNION ALL SELECT s_name, s_acctbal, 2, s_suppkey, s_nationkey FROM supplier),
 r AS (SELECT *, row_number() OVER (PARTITION BY k, nat ORDER BY prio, name) AS n FROM u) SELECT k, nat, name, prio FROM r WHERE n = 1"""
)
def union_by_priority(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit(1).alias("prio"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nat"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit(2).alias("prio"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nat"))
    return en.keep_first(a.unionByName(b), ["k", "nat"], ["prio", "name"]).select("k", "nat", "name", "prio")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY lower(trim(text))")
def distinct_texts(spark, d):
    key = F.xxhash64(F.lower(F.trim("text")))
    rows = table(spark, d, "documents").select("doc_id", key.alias("h"), F.sha2(F.lower(F.trim("text")), 256).alias("s"))
    return rows.groupBy("h", "s").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS k FROM lineitem)
 SELECT o_orderkey, o_totalprice, l_partkey, l_quantity FROM orders JOIN l ON l_orderkey = o_orderkey WHERE k = 1""")
def report_join(spark, d):
    last = jn.last_by_key(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "l_partkey", "l_quantity")


@query(
    """WITH x AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS k FROM part GROUP BY 1, 2, 3), o AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT p_partkey, coalesce(x.k, o.k) AS match FROM part p LEFT JOIN x ON x.p_brand = p.p_brand AND x.p_type = p.p_type AND x.p_size = p.p_size + 1 LEFT JOIN o ON o.p_brand = p.p_brand AND o.p_type = p.p_type"""
)
def lookup_with_fallback(spark, d):
    """For each part the next size of its brand and type, else the only part of that brand and type."""
    parts = table(spark, d, "part")
    known = parts.select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("match"))
    rows = parts.select("p_partkey", "p_brand", "p_type", (F.col("p_size") + 1).alias("p_size"))
    return jn.lookup_with_fallback(rows, known, ["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], "match").select("p_partkey", "match")


@query(
    """WITH s AS (SELECT s_nationkey AS nat, floor(s_acctbal / 1000)::BIGINT AS band, s_suppkey FROM supplier), c AS (SELECT c_custkey, c_nationkey AS nat, floor(c_acctbal / 1000)::BIGINT AS band FROM customer),
 x AS (SELECT nat, band, min(s_suppkey) AS k FROM s GROUP BY 1, 2), o AS (SELECT nat, min(s_suppkey) AS k FROM s GROUP BY 1 HAVING count(*) = 1)
 SELECT c_custkey, coalesce(x.k, o.k) AS match FROM c LEFT JOIN x ON x.nat = c.nat AND x.band = c.band LEFT JOIN o ON o.nat = c.nat"""
)
def supplier_with_fallback(spark, d):
    """All customers against all suppliers: one of the same nation and balance band, else the nation's only one."""
    band = lambda c: F.floor(F.col(c) / 1000)
    known = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nat"), band("s_acctbal").alias("band"), F.col("s_suppkey").alias("match"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nat"), band("c_acctbal").alias("band"))
    return jn.lookup_with_fallback(rows, known, ["nat", "band"], ["nat"], "match").select("c_custkey", "match")


@query("""WITH x AS (SELECT *, max((o_orderpriority = '1-URGENT')::INT) OVER (PARTITION BY o_custkey) AS has_it FROM orders) SELECT o_orderkey FROM x WHERE has_it = 0 OR o_orderpriority = '1-URGENT'""")
def preferred_or_all(spark, d):
    return en.preferred_or_all(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


@query("""WITH x AS (SELECT *, count(*) FILTER (l_discount < 0.07) OVER w AS kept, count(*) OVER w AS total FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM x WHERE l_discount < 0.07 OR NOT (kept >= 20 AND kept >= 0.62 * total)""")
def guarded_filter(spark, d):
    return en.guarded_filter(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_discount") < 0.07, 20, 0.62).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS l_quantity_spread, round(max(l_extendedprice) - min(l_extendedprice), 2) AS l_extendedprice_spread, (max(l_quantity) - min(l_quantity) > 40 OR max(l_extendedprice) - min(l_extendedprice) > 50000) AS flagged FROM lineitem GROUP BY 1""")
def source_disagreement(spark, d):
    return rounded(en.disagreement(table(spark, d, "lineitem"), ["l_orderkey"], {"l_quantity": 40.0, "l_extendedprice": 50000.0}), 2, "l_extendedprice_spread")


@query("SELECT c_nationkey, c_custkey, c_mktsegment, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1")
def best_ranked_candidate(spark, d):
    rows = table(spark, d, "customer").withColumn("own", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    return best_ranked(rows, ["c_nationkey"], ["own", "c_acctbal"], "c_custkey").select("c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("""SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1""")
def nested_report(spark, d):
    rows = ns.nest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return rows.select("o_custkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["ord"].cast("string"), x["o_orderstatus"])), ",").alias("items"))
