"""Aggregations over metric records. All are plain grouped aggregates, so Spark combines them before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value * weight over sum of weight, of rows with both and a positive weight; null without any."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.sum(F.when(ok, F.col(value) * F.col(weight))) / F.sum(F.when(ok, F.col(weight)))


def ratio_of_sums(part: str, whole: str) -> Column:
    """Sum over sum; a missing part counts as 0; null if the whole is 0."""
    total = F.sum(whole)
    return F.sum(F.coalesce(F.col(part), F.lit(0))) / F.when(total != 0, total)


def percentile(value: str, p: float) -> Column:
    """Exact percentile, linear between ranks; 0 without values."""
    return F.coalesce(F.expr(f"percentile({value}, {p})"), F.lit(0.0))


def percentile_of_bins(value: str, q: float, bins: int = 100) -> Column:
    """The nearest of the bins - 1 inclusive quantile cuts to q (first and last at least)."""
    cut = min(max(int(round(q * (bins - 1))) - 1, 0), bins - 2)
    return F.expr(f"percentile({value}, {(cut + 1) / bins})")


def percentile_nearest_rank(value: str, p: float = 0.95) -> Column:
    """The value at place floor(p * n) of the sorted values, from 0: the first whose share of values up to it exceeds p,
    which counts of distinct values, merged like sums, are enough for. p lies below 1; null without values."""
    return F.expr(f"percentile_disc({p + 1e-12!r}D) WITHIN GROUP (ORDER BY {value})")


def offset_and_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the median and the mean absolute distance from it."""
    medians = df.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5)").alias("offset"))
    return df.join(medians, keys).groupBy(*keys).agg(F.max("offset").alias("offset"), F.avg(F.abs(F.col(value) - F.col("offset"))).alias("spread"))


def bucket_counts(value: str, good: float, warn: float, severe: float) -> list[Column]:
    """good: up to the first limit; warn: up to the second; bad: beyond; severe overlaps bad."""
    a = F.abs(F.col(value))
    return [F.count_if(a <= good).alias("good"), F.count_if((a > good) & (a <= warn)).alias("warn"), F.count_if(a > warn).alias("bad"), F.count_if(a > severe).alias("severe")]


def std_or_zero(value: str) -> Column:
    """Population standard deviation; 0 for fewer than two values."""
    return F.when(F.count(value) > 1, F.stddev_pop(value)).otherwise(0.0)


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the most frequent value; of equally frequent ones the one seen first. With its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "__first")
    return counts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__first")


def consensus(df: DataFrame, keys: list[str], value: str, least: int, share: float) -> DataFrame:
    """Per key the most frequent value (ties: the least), if it has ``least`` rows and this share of them."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumns({"total": F.sum("n").over(w), "__r": F.row_number().over(w.orderBy(F.col("n").desc(), value))})
    return ranked.where((F.col("__r") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).drop("__r")


def moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key count, means and variances of two columns, from sums that merge across partitions."""
    n = F.count("*")
    sums = df.groupBy(*keys).agg(n.alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    var = lambda s, q: F.greatest(F.lit(0.0), F.col(q) / F.col("n") - (F.col(s) / F.col("n")) ** 2)
    return sums.select(*keys, "n", (F.col("sx") / F.col("n")).alias("mean_x"), (F.col("sy") / F.col("n")).alias("mean_y"), var("sx", "sxx").alias("var_x"), var("sy", "syy").alias("var_y"))


def thresholds_with_default(df: DataFrame, key: str, value: str, p: float, factor: float, empty: float) -> DataFrame:
    """A row per key (and key -1 for all rows): the percentile times factor; ``empty`` where there are no values."""
    at = lambda: F.coalesce(F.expr(f"percentile({value}, {p})") * factor, F.lit(empty))
    whole = df.agg(at().alias("threshold")).select(F.lit(-1).cast("long").alias(key), "threshold")
    return df.groupBy(F.col(key).cast("long").alias(key)).agg(at().alias("threshold")).unionByName(whole)


def counter_map(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key a map of value to count, with sorted entries. For values of few kinds."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def map_sum(df: DataFrame, column: str) -> DataFrame:
    """Sum per map key over all rows, and its share of the grand total."""
    sums = df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))
    grand = F.sum("total").over(Window.partitionBy())  # one row per map key
    return sums.withColumn("share", F.when(grand != 0, F.col("total") / grand).otherwise(0.0))


def outcome_pivot(df: DataFrame, phase: str, outcome: str, kinds: list[str]) -> DataFrame:
    """Per phase the count of each kind of outcome and of all rows, with the share of the first kind."""
    wide = df.groupBy(phase).agg(*[F.count_if(F.col(outcome) == k).alias(k) for k in kinds], F.count("*").alias("total"))
    return wide.withColumn("first_share", F.col(kinds[0]) / F.col("total"))


def tag_counts(df: DataFrame, tags: str, where: Column) -> DataFrame:
    """How often each tag of an array column occurs in the rows chosen."""
    return df.where(where).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def repeat_capped(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """Keeps the k-th row of a key while k is at most the cap (at least 1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max(1, cap)).drop("__k")


def metric_deltas(base: DataFrame, corrected: DataFrame, keys: list[str], metrics: dict[str, int], epsilon: float = 1e-12) -> DataFrame:
    """Long rows (keys, metric, baseline, corrected, delta, improved). ``metrics``: name to +1 (more is better) or -1.
    improved is null for a change under epsilon or a missing value."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name), F.lit(d).alias("direction")) for m, d in metrics.items()])).alias("x")).select(*keys, "x.*")

    both = long(base, "baseline").join(long(corrected, "corrected").drop("direction"), [*keys, "metric"])
    delta = F.col("corrected") - F.col("baseline")
    improved = F.when(F.abs(delta) >= epsilon, delta * F.col("direction") > 0)
    return both.select(*keys, "metric", "baseline", "corrected", delta.alias("delta"), improved.alias("improved"))


def net_outcome(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: improved and regressed metrics, and their difference."""
    out = deltas.groupBy(*keys).agg(F.count_if(F.coalesce("improved", F.lit(False))).alias("improved_metrics"), F.count_if(~F.coalesce("improved", F.lit(True))).alias("regressed_metrics"))
    return out.withColumn("net_score", F.col("improved_metrics") - F.col("regressed_metrics"))


def check_thresholds(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of rules (rule, limit; names start with min_ or max_) by metrics (metric, value). A missing metric
    violates its rule; equality passes."""
    named = rules.withColumns({"kind": F.substring("rule", 1, 3), "metric": F.expr("substring(rule, 5)")})
    both = named.join(metrics, "metric", "left")
    bad = F.col("value").isNull() | ((F.col("kind") == "min") & (F.col("value") < F.col("limit"))) | ((F.col("kind") == "max") & (F.col("value") > F.col("limit")))
    return both.where(bad).select("rule", "limit", "value", F.when(F.col("value").isNull(), "missing").otherwise("violated").alias("status"))


def runtime_profile(df: DataFrame, keys: list[str], phases: str) -> DataFrame:
    """Per key of a map of phase to seconds: total, the longest phase (ties: the first name) and its share."""
    long = df.select(*keys, F.explode(phases).alias("phase", "seconds"))
    out = long.groupBy(*keys).agg(F.sum("seconds").alias("total"), F.max_by("phase", F.struct("seconds", "phase")).alias("longest"), F.max("seconds").alias("longest_seconds"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("longest_seconds") / F.col("total")).otherwise(0.0))


def stage_effects(df: DataFrame, keys: list[str], stage: str, value: str, least: float = 0.05) -> DataFrame:
    """Per key over ordered stages: the first stage that changed the value by ``least`` or more, the stage of the
    greatest change (ties: the first) and last less first value."""
    w = Window.partitionBy(*keys).orderBy(stage)
    steps = df.withColumn("step", F.col(value) - F.lag(value).over(w))
    big = F.abs(F.col("step")) >= least
    return steps.groupBy(*keys).agg(
        F.min(F.when(big, F.col(stage))).alias("first_changed"),
        F.min_by(F.when(big, F.col(stage)), F.when(big, F.struct(-F.abs(F.col("step")), F.col(stage)))).alias("most_changed"),
        (F.max_by(value, stage) - F.min_by(value, stage)).alias("total_change"),
    )


def positional_vote(df: DataFrame, keys: list[str], place: str, token: str, order: str) -> DataFrame:
    """Per key and place the token with most votes (ties: longest, then least), its votes and its share."""
    votes = df.groupBy(*keys, place, token).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*keys, place)
    ranked = votes.withColumns({"share": F.col("votes") / F.sum("votes").over(w), "__r": F.row_number().over(w.orderBy(F.col("votes").desc(), F.length(token).desc(), token))})
    return ranked.where("__r = 1").drop("__r")


def words_in_runs(df: DataFrame, keys: list[str], text: str, run: int = 8) -> DataFrame:
    """Rows (keys, run, place, token): each text's words by place from 0, parted at spaces, empty ones left out. ``run`` is place / run.

    Dealt by keys and run before they are rows of their own: what is sent is about as long as the texts, and groups by keys,
    run and place (or more) need no further exchange.
    """
    words = F.split(text, " ")
    starts = F.sequence(F.lit(0), F.size("__words") - 1, F.lit(run))
    part = lambda k: F.struct((k / run).cast("long").alias("run"), F.array_join(F.slice("__words", k + 1, run), " ").alias("part"))
    parts = df.where(F.col(text).isNotNull()).select(*keys, words.alias("__words")).select(*keys, F.explode(F.transform(starts, part)).alias("__x")).select(*keys, "__x.*")
    dealt = parts.repartition(*keys, "run").select(*keys, "run", F.posexplode(F.split("part", " ")).alias("__p", "token"))
    return dealt.where("token <> ''").select(*keys, "run", (F.col("run") * run + F.col("__p")).alias("place"), "token")
