"""Queries over events as points and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import islands as il
from spanloom.operators import joins as jn
from spanloom.operators import windows as wn
from spanloom.sources.tables import table
from spanloom.streaming.tracks import timed_tracks_batch, session_counts, track_batch

from .base import E, S, of_type, points, query, rounded, spans

U = ["user_id"]
HOUR = 6 * 3600.0
MERGE = """, o AS (SELECT user_id, "start", "end", max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
 i AS (SELECT *, sum(CASE WHEN "start" <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM o),
 {out} AS (SELECT user_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY user_id, island)"""


def merged(src: str, out: str) -> str:
    """SQL of the coalesced set ``out`` of the intervals in ``src``."""
    return MERGE.format(src=src, out=out).replace(" o AS", f" o_{out} AS").replace("FROM o)", f"FROM o_{out})").replace(" i AS", f" i_{out} AS").replace("FROM i GROUP", f"FROM i_{out} GROUP")


@query(
    f"""WITH {E}, g AS (SELECT user_id, tm, event_id, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS gap FROM e),
 b AS (SELECT user_id, sum(CASE WHEN gap >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS block FROM g),
 c AS (SELECT user_id, block, count(*) AS n FROM b GROUP BY ALL)
 SELECT user_id, count(*) AS blocks, max(n) AS longest, sum(n * n)::BIGINT AS sum_squares FROM c GROUP BY user_id"""
)
def session_blocks(spark, d):
    rows = il.sessions(points(spark, d), U, "at", "at", 1800.0, "event_id")
    sizes = rows.groupBy("user_id", "block").agg(F.count("*").alias("n"))
    return sizes.groupBy("user_id").agg(F.count("*").alias("blocks"), F.max("n").alias("longest"), F.sum(F.col("n") * F.col("n")).alias("sum_squares"))


@query(
    f"""WITH {S}, g AS (SELECT *, "start" - lag("end") OVER (PARTITION BY user_id ORDER BY "start", event_id) AS gap FROM s),
 b AS (SELECT *, sum(CASE WHEN gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", event_id ROWS UNBOUNDED PRECEDING) AS block FROM g)
 SELECT user_id, block::BIGINT AS block, count(*) AS n, arg_min("start", ("start", event_id)) AS "start", arg_max("end", ("start", event_id)) AS "end" FROM b GROUP BY user_id, block"""
)
def session_ranges(spark, d):
    rows = il.sessions(spans(spark, d), U, "start", "end", 3600.0, "event_id")
    return il.block_ranges(rows, U, "start", "end", "event_id").withColumn("block", F.col("block").cast("long"))


@query(
    f"""WITH {E}, g AS (SELECT *, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) AS gap FROM e),
 b AS (SELECT *, sum(CASE WHEN gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS block FROM g)
 SELECT user_id, round(min(tm), 3) AS first, round(max(tm) + 3600, 3) AS last, count(*) AS n FROM b GROUP BY user_id, block"""
)
def session_windows(spark, d):
    """The built-in session window, as used on streams."""
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    out = session_counts(rows, U, "at", "1 hour")
    from .base import seconds

    return rounded(out.select("user_id", seconds("start").alias("first"), seconds("end").alias("last"), "n"), 3)


@query(f"WITH {S}{merged('s', 'm')} SELECT * FROM m")
def interval_coalesce(spark, d):
    return iv.coalesce(spans(spark, d), U)


@query(
    f"""WITH {S}, w AS (SELECT user_id, greatest("start", 1704672000.0) AS "start", least("end", 1705276800.0) AS "end" FROM s), k AS (SELECT * FROM w WHERE "end" > "start"){merged('k', 'm')} SELECT * FROM m"""
)
def interval_clip(spark, d):
    return iv.clip(spans(spark, d), U, 1704672000.0, 1705276800.0)


COMPLEMENT = f"""{S}, c AS (SELECT * FROM s WHERE event_type = 'view'), w AS (SELECT user_id, min("start") AS low, max("end") AS high FROM s GROUP BY user_id){merged('c', 'm')},
 x AS (SELECT user_id, low AS "start", low AS "end" FROM w UNION ALL SELECT user_id, "start", "end" FROM m UNION ALL SELECT user_id, high, high FROM w),
 g AS (SELECT user_id, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, "start" AS b FROM x)"""


@query(f"""WITH {COMPLEMENT} SELECT user_id, a AS "start", b AS "end" FROM g WHERE b > a""")
def interval_complement(spark, d):
    rows = spans(spark, d)
    windows = rows.groupBy("user_id").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    return iv.complement(of_type(rows, "view"), windows, U)


TWO = f"""{S}, c AS (SELECT * FROM s WHERE event_type = 'click'), v AS (SELECT * FROM s WHERE event_type = 'view'){merged('c', 'mc')}{merged('v', 'mv')},
 x AS (SELECT mc.user_id, greatest(mc."start", mv."start") AS "start", least(mc."end", mv."end") AS "end" FROM mc JOIN mv ON mc.user_id = mv.user_id AND mc."start" < mv."end" AND mv."start" < mc."end")"""


@query(f"WITH {TWO} SELECT * FROM x")
def interval_intersect(spark, d):
    rows = spans(spark, d)
    return iv.intersect(of_type(rows, "click"), of_type(rows, "view"), U)


@query(f"""WITH {S} SELECT user_id, round(sum(greatest(0, "end" - "start")), 2) AS total FROM s GROUP BY user_id""")
def interval_measure(spark, d):
    return rounded(iv.measure(spans(spark, d), U), 2)


@query(
    f"""WITH {TWO}, wc AS (SELECT user_id, min("start") AS low, max("end") AS high FROM mc GROUP BY user_id),
 gx AS (SELECT wc.user_id, low AS "start", low AS "end" FROM wc UNION ALL SELECT wc.user_id, high, high FROM wc UNION ALL
        SELECT wc.user_id, greatest(mv."start", low), least(mv."end", high) FROM wc JOIN mv USING (user_id) WHERE least(mv."end", high) > greatest(mv."start", low)),
 gg AS (SELECT user_id, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, "start" AS b FROM gx),
 p AS (SELECT mc.user_id, count(*) AS n FROM mc JOIN (SELECT * FROM gg WHERE b > a) q ON mc.user_id = q.user_id AND mc."start" < q.b AND q.a < mc."end" WHERE least(mc."end", q.b) - greatest(mc."start", q.a) >= 0.5 GROUP BY 1),
 t AS (SELECT user_id, sum("end" - "start") AS l FROM mc GROUP BY 1), f AS (SELECT user_id, sum("end" - "start") AS l FROM mv GROUP BY 1), h AS (SELECT user_id, sum("end" - "start") AS l FROM x GROUP BY 1)
 SELECT t.user_id, round(CASE WHEN t.l > 0 THEN coalesce(h.l, 0) / t.l ELSE 0 END, 6) AS recall, round(CASE WHEN f.l > 0 THEN coalesce(h.l, 0) / f.l ELSE 0 END, 6) AS "precision", coalesce(p.n, 0) AS uncovered
 FROM t LEFT JOIN f USING (user_id) LEFT JOIN h USING (user_id) LEFT JOIN p USING (user_id)"""
)
def interval_coverage(spark, d):
    rows = spans(spark, d)
    return rounded(iv.coverage(of_type(rows, "click"), of_type(rows, "view"), U, 0.5), 6)


@query(
    f"""WITH {S}, h AS (SELECT p.event_id, sum(least(p."end", m."end") - greatest(p."start", m."start")) AS overlap FROM s p JOIN s m ON p.user_id = m.user_id AND p."start" < m."end" AND m."start" < p."end"
 WHERE p.event_type = 'error' AND m.event_type = 'view' GROUP BY 1)
 SELECT s.user_id, s.event_id, round(coalesce(overlap, 0), 3) AS overlap FROM s LEFT JOIN h USING (event_id) WHERE s.event_type = 'error'"""
)
def interval_overlap_measure(spark, d):
    rows = spans(spark, d)
    return rounded(iv.overlap_measure(of_type(rows, "error").select("user_id", "event_id", "start", "end"), of_type(rows, "view"), U, "event_id", HOUR), 3)


@query(f"""WITH {S} SELECT e.event_id, e.user_id FROM e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.event_type = 'view' AND e.tm BETWEEN s."start" AND s."end")""")
def points_in_intervals(spark, d):
    return iv.points_within(of_type(points(spark, d), "click").select("event_id", "user_id", "at"), of_type(spans(spark, d), "view"), U, "at").select("event_id", "user_id")


RUNS = """, r AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS island, coalesce(lead(tm) OVER (PARTITION BY user_id ORDER BY tm), tm) AS nxt FROM f),
 z AS (SELECT user_id, min(tm) AS "start", max(nxt) AS "end" FROM r WHERE flag GROUP BY user_id, island)"""


@query(f"""WITH {E}, f AS (SELECT user_id, tm, value < 40 AS flag FROM e){RUNS} SELECT * FROM z WHERE "end" - "start" >= 3600""")
def boolean_runs(spark, d):
    return iv.runs(points(spark, d), U, "at", F.col("value") < 40, 3600.0)


@query(
    f"""WITH {E}, p AS (SELECT user_id, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM e GROUP BY 1), f AS (SELECT user_id, tm, value < p5 + 0.1 * (p95 - p5) AS flag FROM e JOIN p USING (user_id)){RUNS} SELECT * FROM z"""
)
def percentile_runs(spark, d):
    return iv.percentile_runs(points(spark, d).select("user_id", "at", "value"), U, "at", "value")


@query(
    f"""WITH {S}, p AS (SELECT user_id, quantile_cont(value, 0.99) AS p99 FROM e GROUP BY 1),
 h AS (SELECT s.event_id, avg(CASE WHEN p99 <> 0 AND e.value / p99 > 0.3 THEN 1.0 ELSE 0.0 END) AS fraction FROM s JOIN e ON s.user_id = e.user_id AND e.tm BETWEEN s."start" AND s."end" JOIN p ON p.user_id = s.user_id WHERE s.event_type = 'purchase' GROUP BY 1)
 SELECT user_id, event_id, round(coalesce(fraction, 0), 6) AS fraction FROM s LEFT JOIN h USING (event_id) WHERE event_type = 'purchase'"""
)
def activity_fraction(spark, d):
    probes = of_type(spans(spark, d), "purchase").select("user_id", "event_id", "start", "end")
    return rounded(iv.activity_fraction(probes, points(spark, d).select("user_id", "at", "value"), U, "event_id", least=0.3, bucket=HOUR), 6)


@query(f"""WITH {E}, g AS (SELECT user_id, tm AS "start", lead(tm) OVER (PARTITION BY user_id ORDER BY tm) AS "end" FROM e) SELECT *, "end" - "start" AS length FROM g WHERE "end" - "start" >= 86400""")
def large_gaps(spark, d):
    return iv.gaps(points(spark, d), U, "at", 86400.0)


@query(f"WITH {E}, g AS (SELECT user_id, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) AS gap FROM e) SELECT user_id, count(*) FILTER (gap > 43200) AS n_gaps FROM g GROUP BY 1")
def gap_counts(spark, d):
    return iv.count_gaps(points(spark, d), U, "at", 43200.0)


@query(f"""WITH {S}, g AS (SELECT user_id, greatest(0, "end" - 0.5) AS "start", lead("start") OVER (PARTITION BY user_id ORDER BY "start", "end") + 0.5 AS "end" FROM s) SELECT * FROM g WHERE "end" - "start" >= 1""")
def gap_windows(spark, d):
    return iv.gap_windows(spans(spark, d), U)


@query(
    f"""WITH {S}, g AS (SELECT event_id, "start" AS a, "end" AS b, lead("start") OVER w AS c, lead("end") OVER w AS f FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)),
 x AS (SELECT *, greatest(0, least(b, f) - greatest(a, c)) AS o FROM g WHERE c IS NOT NULL)
 SELECT event_id FROM x WHERE o / greatest(b - a, 0.1) >= 0.3 AND o / greatest(f - c, 0.1) >= 0.3"""
)
def mutual_overlaps(spark, d):
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    rows = spans(spark, d).withColumns({"s2": F.lead("start").over(w), "e2": F.lead("end").over(w)}).where("s2 IS NOT NULL")
    return rows.where(iv.mutual_overlap(*(F.col(c) for c in ("start", "end", "s2", "e2")), least=0.3)).select("event_id")


@query(f"""WITH {S} SELECT user_id, min("start" - 1704100000) FILTER ("start" - 1704100000 < -5) AS earliest, max("end" - 1704100000) FILTER ("end" - 1704100000 > 2500000 + 5) AS latest FROM s GROUP BY 1""")
def bound_violations(spark, d):
    rows = spans(spark, d).select("user_id", (F.col("start") - 1704100000).alias("start"), (F.col("end") - 1704100000).alias("end"))
    return iv.bound_violations(rows, U, F.lit(2500000.0), 5.0)


@query(
    f"""WITH {E}, g AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS step FROM e) SELECT event_id, sum(CASE WHEN step >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS "row" FROM g"""
)
def chained_rows(spark, d):
    return il.chained_groups(points(spark, d), U, "value", "event_id", 3.0).select("event_id", F.col("row").cast("long").alias("row"))


@query("SELECT floor(value::BIGINT / 40)::BIGINT AS lane, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT trunc(value) AS value FROM events) GROUP BY 1")
def lane_counts(spark, d):
    rows = points(spark, d).select(F.floor("value").cast("double").alias("value"))
    return rounded(rows.groupBy(il.lane(F.col("value")).alias("lane")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 6)


@query(
    f"""WITH {E}, n AS (SELECT *, CASE WHEN value <= 80 AND lag(value) OVER w <= 80 AND event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm)),
 r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS run FROM n)
 SELECT user_id, min(tm) AS first, max(tm) AS last, count(*) AS n FROM r WHERE value <= 80 GROUP BY user_id, run HAVING count(*) >= 3"""
)
def stall_runs(spark, d):
    return il.stall_runs(points(spark, d), U, "at", ["event_type"], F.col("value") <= 80, 3)


@query(f"WITH {E} SELECT user_id, event_type, count(*) AS n, max(value) - min(value) AS spread FROM e GROUP BY 1, 2 HAVING count(*) >= 5")
def repeated_groups(spark, d):
    return il.repeated_groups(points(spark, d), ["user_id", "event_type"], "value", 5)


@query(
    f"""WITH {E}, a AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS next_value FROM e) SELECT event_type, next_value, count(*) AS n FROM a WHERE next_value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2"""
)
def adjacent_pairs(spark, d):
    return il.adjacent_pairs(points(spark, d), U, ["at", "event_id"], "event_type").groupBy("event_type", "next_value").agg(F.count("*").alias("n"))


@query(
    f"""WITH {S}, o AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600 AS reach FROM s)
 SELECT event_id, sum(CASE WHEN "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING)::BIGINT AS component FROM o"""
)
def overlap_components(spark, d):
    return il.overlap_components(spans(spark, d), U, 600.0).select("event_id", F.col("component").cast("long").alias("component"))


@query(
    f"""WITH {E}, l AS (SELECT *, min(tm) OVER (PARTITION BY user_id, event_type) AS least FROM e) SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY least, event_type, tm, event_id)::BIGINT AS place FROM l"""
)
def block_order(spark, d):
    return il.order_blocks(points(spark, d), U, "event_type", "at", "event_id").select("event_id", F.col("place").cast("long").alias("place"))


def asof_sql(op: str, order: str, tolerance: str) -> str:
    return f"""WITH {E}, c AS (SELECT * FROM e WHERE event_type = 'click'), v AS (SELECT * FROM e WHERE event_type = 'view'),
 j AS (SELECT c.event_id, v.tm AS value_at, v.value, row_number() OVER (PARTITION BY c.event_id ORDER BY {order}, v.value) AS r FROM c JOIN v ON c.user_id = v.user_id AND {op} {tolerance})
 SELECT c.event_id, j.value_at, j.value FROM c LEFT JOIN (SELECT * FROM j WHERE r = 1) j USING (event_id)"""


def _clicks_views(spark, d):
    rows = points(spark, d)
    return of_type(rows, "click").select("event_id", "user_id", "at"), of_type(rows, "view").select("user_id", "at", "value")


@query(asof_sql("v.tm <= c.tm", "v.tm DESC", "AND c.tm - v.tm <= 86400"))
def as_of_backward(spark, d):
    a, b = _clicks_views(spark, d)
    return jn.as_of(a, b, U, "at", "value", "backward", 86400.0).select("event_id", "value_at", "value")


@query(asof_sql("v.tm >= c.tm", "v.tm", "AND v.tm - c.tm <= 86400"))
def as_of_forward(spark, d):
    a, b = _clicks_views(spark, d)
    return jn.as_of(a, b, U, "at", "value", "forward", 86400.0).select("event_id", "value_at", "value")


@query(asof_sql("true", "abs(v.tm - c.tm), v.tm", ""))
def as_of_nearest(spark, d):
    a, b = _clicks_views(spark, d)
    return jn.nearest(a, b, U, "at", "value").select("event_id", "value_at", "value")


@query(
    f"""WITH {E}, w AS (SELECT event_id, user_id, tm - 3600 AS low, coalesce(lead(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id), tm + 7200) AS high FROM e WHERE event_type = 'purchase')
 SELECT w.event_id, count(*) AS n, round(avg(p.value), 6) AS mean, min(p.tm) AS first FROM w JOIN e p ON w.user_id = p.user_id AND p.tm >= low AND p.tm < high GROUP BY 1"""
)
def band_join(spark, d):
    rows = points(spark, d)
    windows = jn.windows_to_next(of_type(rows, "purchase").select("event_id", "user_id", "at"), U, "at", "event_id", 3600.0, 7200.0).drop("at")
    hits = jn.band(windows, rows.select("user_id", "at", "value"), U, "at", HOUR * 4)
    return rounded(hits.groupBy("event_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("at").alias("first")), 6, "mean")


@query(
    f"""WITH {S} SELECT e.event_id, min(s.event_id) AS span_id FROM (SELECT * FROM e WHERE event_type = 'click') e LEFT JOIN (SELECT * FROM s WHERE event_type = 'view') s ON s.user_id = e.user_id AND e.tm BETWEEN s."start" AND s."end" GROUP BY 1"""
)
def enclosing_span(spark, d):
    views = of_type(spans(spark, d), "view").select("user_id", F.col("event_id").alias("span_id"), "start", "end")
    return jn.enclosing(of_type(points(spark, d), "click").select("event_id", "user_id", "at"), views, U, "at", "span_id", "event_id", HOUR).select("event_id", "span_id")


@query(
    f"""WITH {E}, p AS (SELECT a.event_id, b.event_id AS other, abs(a.tm - b.tm) / 3600 - CASE WHEN b.value > 100 THEN 1 ELSE 0 END + CASE WHEN b.tm < a.tm - 1800 THEN 1 ELSE 0 END AS score, b.tm
   FROM e a JOIN e b ON a.user_id = b.user_id AND b.tm >= a.tm - 14400 AND b.tm < a.tm + 14400 WHERE a.event_type = 'error' AND b.event_type = 'view'),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score, tm, other) AS n FROM p) SELECT event_id, other, round(score, 6) AS score FROM r WHERE n = 1"""
)
def scored_nearest(spark, d):
    rows = points(spark, d)
    a = of_type(rows, "error").select("event_id", "user_id", F.col("at").alias("a_at"), (F.col("at") - 14400).alias("low"), (F.col("at") + 14400).alias("high"))
    b = of_type(rows, "view").select("user_id", F.col("event_id").alias("other"), "at", "value")
    score = F.abs(F.col("a_at") - F.col("at")) / 3600 - F.when(F.col("value") > 100, 1).otherwise(0) + F.when(F.col("at") < F.col("a_at") - 1800, 1).otherwise(0)
    return rounded(jn.best_scored(jn.band(a, b, U, "at", HOUR), "event_id", score, ["at", "other"]).select("event_id", "other", "score"), 6)


@query(f"""WITH {E} SELECT c.event_id, round(coalesce((SELECT sum(value) FROM e x WHERE x.user_id = c.user_id AND x.event_type = 'purchase' AND x.tm <= c.tm), 0), 3) AS shift FROM e c WHERE event_type = 'click'""")
def cumulative_edits(spark, d):
    rows = points(spark, d)
    out = jn.cumulative_edits(of_type(rows, "click").select("event_id", "user_id", "at"), of_type(rows, "purchase").select("user_id", F.col("at").alias("cut"), "value"), U, "at", "cut", "value")
    return rounded(out.select("event_id", "shift"), 3)


@query(f"""WITH {S} SELECT event_id, round(greatest(0, coalesce(lead("start") OVER (PARTITION BY user_id ORDER BY "start", event_id) - "start", "end" - "start")), 3) AS slot FROM s""")
def slot_durations(spark, d):
    return rounded(wn.slot_durations(spans(spark, d), U, "start", "event_id", F.col("end")).select("event_id", "slot"), 3)


@query(
    f"""WITH {E}, n AS (SELECT event_id, tm, lead(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS nxt FROM e) SELECT event_id, CASE WHEN nxt IS NULL THEN tm + 3 WHEN nxt - tm > 10000 THEN tm + 5 ELSE nxt END AS end_at FROM n"""
)
def capped_ends(spark, d):
    return wn.capped_ends(points(spark, d), U, "at", "event_id", 10000.0).select("event_id", "end_at")


@query(f"""WITH {E}, n AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS p FROM e) SELECT event_id FROM n WHERE p IS NULL OR p <> event_type""")
def consecutive_duplicates(spark, d):
    return wn.drop_consecutive_duplicates(points(spark, d), U, ["at", "event_id"], "event_type").select("event_id")


@query(
    f"""WITH {E}, n AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e) SELECT event_id, CASE WHEN value - 3 < 0 THEN 'negative' ELSE 'out_of_order' END AS issue FROM n WHERE value - 3 < 0 OR value < p"""
)
def order_violations(spark, d):
    rows = points(spark, d).withColumns({"s": F.col("value"), "z": F.col("value") + F.when(F.col("value") - 3 < 0, -1).otherwise(1)})
    return wn.order_violations(rows, U, "event_id", "s", "z").select("event_id", "issue")


@query(f"WITH {E} SELECT event_id, trunc(avg(value) OVER (PARTITION BY user_id ORDER BY tm ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))::INTEGER AS smooth FROM e")
def moving_average(spark, d):
    return wn.moving_average(points(spark, d), U, "at", "value").select("event_id", "smooth")


@query(
    f"""WITH {E}, b AS (SELECT event_id, avg(CASE WHEN abs(value - 50) > 30 THEN value - 50 END) OVER w AS m, count(CASE WHEN abs(value - 50) > 30 THEN 1 END) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
 SELECT event_id, round(CASE WHEN n >= 2 AND abs(m) > 1 THEN m ELSE 0 END, 6) AS drift FROM b"""
)
def recent_drift(spark, d):
    rows = points(spark, d).withColumn("offset", F.col("value") - 50)
    return rounded(wn.recent_drift(rows, U, "at", "offset", least=30.0).select("event_id", "drift"), 6)


@query(f"WITH {E} SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS highest FROM e")
def never_falling(spark, d):
    return wn.never_falling(points(spark, d), U, "at", "value", "highest").select("event_id", "highest")


@query(
    f"""WITH {S}, g AS (SELECT *, coalesce(greatest(0, "start" - lag("end") OVER (PARTITION BY user_id ORDER BY "start", event_id) - 7200), 0) AS o FROM s), h AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY "start", event_id ROWS UNBOUNDED PRECEDING) AS shift FROM g)
 SELECT event_id, round("start" - shift, 2) AS new_start, round("end" - shift, 2) AS new_end FROM h"""
)
def closed_gaps(spark, d):
    return rounded(wn.close_gaps(spans(spark, d), U, "start", "end", "event_id", 7200.0).select("event_id", "new_start", "new_end"), 2)


@query(
    f"""WITH {E}, p AS (SELECT event_id, user_id, tm, value / sum(value) OVER (PARTITION BY user_id) * 100 AS part FROM e), c AS (SELECT event_id, part, sum(part) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS upto FROM p)
 SELECT event_id, round(upto - part, 4) AS share_start, round(upto, 4) AS share_end FROM c"""
)
def redistributed(spark, d):
    return rounded(wn.redistribute(points(spark, d), U, "at", "value", F.lit(100.0)).select("event_id", "share_start", "share_end"), 4)


@query(f"WITH {E} SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY tm, event_id)::BIGINT AS occurrence FROM e")
def occurrence_numbers(spark, d):
    return wn.numbered(points(spark, d), ["user_id", "event_type"], ["at", "event_id"]).select("event_id", F.col("occurrence").cast("long").alias("occurrence"))


@query(
    f"""WITH {E}, k AS (SELECT event_id, user_id, tm, CASE WHEN event_type IN ('view', 'purchase') THEN value END AS v FROM e),
 x AS (SELECT event_id, tm, v, last_value(CASE WHEN v IS NOT NULL THEN tm END IGNORE NULLS) OVER a AS ao, last_value(v IGNORE NULLS) OVER a AS av, first_value(CASE WHEN v IS NOT NULL THEN tm END IGNORE NULLS) OVER b AS bo, first_value(v IGNORE NULLS) OVER b AS bv
  FROM k WINDOW a AS (PARTITION BY user_id ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY tm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(coalesce(v, av + (bv - av) * (tm - ao) / nullif(bo - ao, 0), av, bv), 5) AS filled FROM x"""
)
def interpolated(spark, d):
    rows = points(spark, d).withColumn("v", F.when(F.col("event_type").isin("view", "purchase"), F.col("value")))
    return rounded(wn.interpolate_between_anchors(rows, U, "at", "v").select("event_id", "filled"), 5)


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm) AS r FROM e), b AS (SELECT user_id, avg(value) AS base FROM r WHERE r <= 5 GROUP BY 1), x AS (SELECT user_id, tm, abs(value - base) AS dv FROM r JOIN b USING (user_id)),
 m AS (SELECT user_id, quantile_cont(dv, 0.5) AS med FROM x GROUP BY 1), a AS (SELECT user_id, med, quantile_cont(abs(dv - med), 0.5) AS mad FROM x JOIN m USING (user_id) GROUP BY 1, 2),
 u AS (SELECT user_id, tm, (dv > med + greatest(1.0, 1.0 * mad))::INT AS up FROM x JOIN a USING (user_id)),
 h AS (SELECT user_id, tm, min(up) OVER w AS low, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY user_id ORDER BY tm ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
 SELECT user_id, min(CASE WHEN low = 1 AND n = 2 THEN tm END) AS onset FROM h GROUP BY 1"""
)
def sustained_onsets(spark, d):
    return wn.sustained_onset(points(spark, d), U, "at", "value", hold=2, factor=1.0)


@query(
    f"""WITH {E}, g AS (SELECT *, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) AS gap FROM e), t AS (SELECT *, sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS track FROM g)
 SELECT user_id, min(tm) AS first, max(tm) AS last, count(*) AS n, round(sum(value), 3) AS total FROM t GROUP BY user_id, track"""
)
def idle_tracks(spark, d):
    return rounded(track_batch(points(spark, d), "user_id", "at", "value", 7200.0), 3, "total")


@query(
    f"""WITH {E}, t AS (SELECT user_id, floor(tm * 1000) / 1000 AS t, count(*) AS n, sum(value) AS total, min(value) AS low FROM e GROUP BY 1, 2),
 g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS cut FROM t), k AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t) AS track FROM g),
 r AS (SELECT *, count(*) FILTER (low < 20) OVER (PARTITION BY user_id, track ORDER BY t) AS run FROM k),
 h AS (SELECT *, sum(CASE WHEN low >= 20 THEN n ELSE 0 END) OVER (PARTITION BY user_id, track, run ORDER BY t) AS hit, min(CASE WHEN low >= 20 THEN t END) OVER (PARTITION BY user_id, track, run) AS since FROM r)
 SELECT user_id, round(min(t), 3) AS first, round(max(t), 3) AS last, sum(n)::BIGINT AS n, round(sum(total), 3) AS total, round(coalesce(min(CASE WHEN hit >= 3 THEN since END), max(t)), 3) AS seen FROM h GROUP BY user_id, track"""
)
def seen_tracks(spark, d):
    """Each user's tracks, open for a day after the last event, and when three events in a row have been of some value."""
    rows = points(spark, d).withColumn("at", F.timestamp_millis(F.floor(F.col("at") * 1000).cast("long")))
    return rounded(timed_tracks_batch(rows, "user_id", "at", "value", 86_400.0, 20.0, 3), 3)
