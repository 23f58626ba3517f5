"""Repeated lines that were read differently each time: found, grouped and written alike."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import matching_ratio, similarity, similarity_from
from .entity import Row, in_order


def variant_links(lines: DataFrame, keys: list[str], row_id: str, start: str, tokens: str, apart: float = 8.0, least: float = 0.82, few: int = 3, most_texts: int = 512) -> DataFrame:
    """keys, a, b: links between rows that are variants of one line. Rows linked by any number of links belong together.

    Two rows are variants if each has ``few`` tokens or more, their numbers of tokens differ by one at most, they start
    ``apart`` seconds or more from each other, their texts are alike (``least``), and they share two tokens, or the one
    that the earlier one has. Texts are compared, not rows: each distinct text of a key once with each other one that
    shares a token with it, its most frequent one left aside (texts that share two tokens share another one). Of two such
    texts' rows it is enough to link each with the first and the last row of the other text: whatever row of it is far
    enough away, one of these two is, and these two texts' ends are then linked with each other.

    Of keys with ``most_texts`` distinct texts or fewer these are compared in one pass, without rows for pairs (see ends_of_texts).
    """
    t = lines.where(F.col(start).isNotNull() & (F.size(tokens) >= few)).select(*keys, F.col(row_id).alias("__id"), F.col(start).cast("double").alias("__at"), F.col(tokens).alias("__tokens"))
    t = t.withColumn("__text", F.array_join("__tokens", " "))
    ends = lambda f: f(F.struct("__at", "__id"))
    texts = t.groupBy(*keys, "__text").agg(F.first("__tokens").alias("__tokens"), ends(F.min).alias("__first"), ends(F.max).alias("__last"))
    texts = texts.withColumn("__texts", F.count("*").over(Window.partitionBy(*keys)))
    few_texts = F.col("__texts") <= most_texts
    found = ends_of_texts(texts.where(few_texts).drop("__texts"), keys, apart, least)
    near = t.join(found.where("__text IS NOT NULL"), [*keys, "__text"])
    to_last = near.where(F.col("__l.__at") - F.col("__at") >= apart).select(*keys, F.col("__id").alias("a"), F.col("__l.__id").alias("b"))
    to_first = near.where(F.col("__at") - F.col("__f.__at") >= apart).select(*keys, F.col("__id").alias("a"), F.col("__f.__id").alias("b"))
    own = found.where("__text IS NULL").select(*keys, F.col("__f.__id").alias("a"), F.col("__l.__id").alias("b")).unionByName(to_last).unionByName(to_first)
    texts = texts.where(~few_texts).drop("__texts")
    words = texts.select(*keys, "__text", F.explode(F.array_distinct("__tokens")).alias("__word"))
    often = words.groupBy(*keys, "__word").agg(F.count("*").alias("__n"))
    rank = Window.partitionBy(*keys, "__text").orderBy(F.col("__n").desc(), "__word")
    rare = words.join(often, [*keys, "__word"]).withColumns({"__k": F.row_number().over(rank), "__of": F.count("*").over(Window.partitionBy(*keys, "__text"))}).where("__k > 1 OR __of = 1").select(*keys, "__text", "__word")
    # a text of one distinct token shares that with any text, also where it is the other's most frequent one
    single = words.withColumn("__of", F.count("*").over(Window.partitionBy(*keys, "__text"))).where("__of = 1").select(*keys, "__text", "__word")
    other = lambda df: df.withColumnRenamed("__text", "__other").hint("merge")
    pairs = rare.join(other(rare), [*keys, "__word"]).unionByName(single.join(other(words), [*keys, "__word"])).unionByName(words.join(other(single), [*keys, "__word"]))
    pairs = pairs.select(*keys, F.least("__text", "__other").alias("__text"), F.greatest("__text", "__other").alias("__other")).distinct()
    one, two = (texts.select(*keys, *(F.col(c).alias(f"{n}{c}") for c in ("__text", "__tokens", "__first", "__last"))) for n in ("a", "b"))
    pairs = pairs.withColumnsRenamed({"__text": "a__text", "__other": "b__text"}).join(one, [*keys, "a__text"]).join(two, [*keys, "b__text"]).where(F.abs(F.size("a__tokens") - F.size("b__tokens")) <= 1)
    shared = F.size(F.array_intersect("a__tokens", "b__tokens"))
    enough = lambda c: shared >= F.least(F.lit(2), F.size(F.array_distinct(c)))
    # the earlier row's text comes first in the comparison, so both orders are tried
    ways = pairs.select("*", enough("a__tokens").alias("__ab"), enough("b__tokens").alias("__ba"))
    asked = lambda way, c: F.when(F.col(way), F.col(c))
    alike = {"__ab": similarity_from(asked("__ab", "a__text"), F.col("b__text"), least), "__ba": similarity_from(asked("__ba", "b__text"), F.col("a__text"), least)}
    ways = ways.where("__ab OR __ba").withColumns({c: x.isNotNull() for c, x in alike.items()}).where("__ab OR __ba")
    sides = ways.select(*keys, F.col("a__text").alias("__text"), F.col("b__first").alias("__f"), F.col("b__last").alias("__l"), F.col("__ab").alias("__out"), F.col("__ba").alias("__in"))
    sides = sides.unionByName(ways.where("a__text <> b__text").select(*keys, F.col("b__text").alias("__text"), F.col("a__first").alias("__f"), F.col("a__last").alias("__l"), F.col("__ba").alias("__out"), F.col("__ab").alias("__in")))
    far = t.join(sides, [*keys, "__text"])
    later = far.where(F.col("__out") & (F.col("__l.__at") - F.col("__at") >= apart)).select(*keys, F.col("__id").alias("a"), F.col("__l.__id").alias("b"))
    earlier = far.where(F.col("__in") & (F.col("__at") - F.col("__f.__at") >= apart)).select(*keys, F.col("__id").alias("a"), F.col("__f.__id").alias("b"))
    return own.unionByName(later).unionByName(earlier)


def ends_of_texts(texts: DataFrame, keys: list[str], apart: float, least: float) -> DataFrame:
    """keys, __text, __f, __l over the distinct texts (keys, __text, __tokens, __first, __last) of keys, each of which is held.

    A text's rows are linked with the last row __l that a variant of it has, where that is far enough behind them, and with the
    first row __f that one has which it is a variant of, where that is far enough before. Rows without text link a first row
    __f and a last row __l of two texts. Whatever other row a text's row may be linked with, the text's own first or last row
    is linked with it as well, so these few links join the same rows.
    """

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        held = list(rows)
        key = {k: held[0][k] for k in keys}
        sets = [set(r["__tokens"]) for r in held]
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        place = lambda e: (e["__at"], e["__id"])
        lasts: list[list] = [[] for _ in held]
        firsts: list[list] = [[] for _ in held]
        for i, a in enumerate(held):
            asked = min(2, len(sets[i]))
            for j, b in enumerate(held):  # a's row is the earlier one
                if abs(len(a["__tokens"]) - len(b["__tokens"])) > 1 or len(sets[i] & sets[j]) < asked or not a["__text"] or not b["__text"] or matching_ratio(a["__text"], b["__text"]) < least:
                    continue
                lasts[i].append(b["__last"])
                firsts[j].append(a["__first"])
                if b["__last"]["__at"] - a["__first"]["__at"] >= apart and (x := top(a["__first"]["__id"])) != (y := top(b["__last"]["__id"])):
                    up[x] = y
                    yield key | {"__text": None, "__f": a["__first"], "__l": b["__last"]}
        for r, last, first in zip(held, lasts, firsts, strict=True):
            yield key | {"__text": r["__text"], "__f": min(first, key=place, default=None), "__l": max(last, key=place, default=None)}

    known = texts.dropna(subset=keys).select(*keys, "__text", "__tokens", "__first", "__last")
    kinds = {f.name: f for f in known.schema}
    end = kinds["__first"].dataType
    schema = T.StructType([*(kinds[k] for k in keys), T.StructField("__text", T.StringType()), T.StructField("__f", end), T.StructField("__l", end)])
    return in_order(known, keys, ["__text"], fold, schema)


def joined_rows(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, family (the least id that a row is joined with, itself included) for the rows in ``links`` (keys, a, b).

    Links of a key stream by and join a forest of that key's linked rows, which is all that is held.
    """

    def fold(rows: Iterator[Row]) -> Iterator[Row]:
        up: dict = {}
        key = None

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for r in rows:
            key = {k: r[k] for k in keys}
            a, b = top(r["a"]), top(r["b"])
            up[max(a, b)] = min(a, b)
        for x in up:
            yield key | {"id": x, "family": top(x)}

    kind = links.schema["a"].dataType
    return in_order(links, keys, ["a", "b"], fold, T.StructType([*(f for f in links.schema if f.name in keys), T.StructField("id", kind), T.StructField("family", kind)]))


def read_quality(confidence: Column, uncertainty: Column, support: Column) -> Column:
    """0.8 of the confidence and 0.4 of the support of a reading, less 0.8 of its uncertainty; unknown ones are 0, 0 and 1."""
    known = lambda c, other: F.coalesce(c.cast("double"), F.lit(other))
    return 0.8 * known(confidence, 0.0) + 0.4 * known(support, 1.0) - 0.8 * known(uncertainty, 0.0)


def canonical_variants(lines: DataFrame, keys: list[str], row_id: str, start: str, text: str, tokens: str, quality: str, sure: Column, better: float = 0.18, least: float = 0.86, few: int = 3, **links) -> DataFrame:
    """lines with ``family`` (null without variants, see variant_links) and ``canonical``: the text, or that of the family's
    best reading where that one is clearly better.

    The best reading has the highest quality, then the most tokens, then the least id. Another row of the family takes its
    text if both have as many words, the best one ``few`` or more, its quality is higher by ``better``, the texts are alike
    (``least``), the row isn't ``sure``, and not all tokens are equal. Rows without text keep it.
    """
    family = joined_rows(variant_links(lines, keys, row_id, start, tokens, **links), keys).select(*keys, F.col("id").alias(row_id), "family")
    rows = lines.join(family, [*keys, row_id], "left").withColumn("__sure", F.coalesce(sure, F.lit(False)))
    best = Window.partitionBy(*keys, "family").orderBy(F.col(quality).desc_nulls_last(), F.size(tokens).desc(), row_id)
    rows = rows.withColumn("__best", F.when(F.col("family").isNotNull(), F.first(F.struct(F.col(text).alias("text"), F.col(tokens).alias("tokens"), F.col(quality).alias("quality"), F.col(row_id).alias("id"))).over(best)))
    count = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    own, top = F.col(tokens), F.col("__best.tokens")
    asks = (F.col("__best.id") != F.col(row_id)) & ~F.col("__sure") & (count(F.col("__best.text")) >= few) & (count(F.col(text)) == count(F.col("__best.text"))) & (count(F.col(text)) == F.size(own)) & (F.col("__best.quality") - F.col(quality) >= better) & (own != top)
    alike = similarity(F.array_join(own, " "), F.array_join(top, " ")) >= least
    return rows.withColumn("canonical", F.when(F.coalesce(asks, F.lit(False)) & alike, F.col("__best.text")).otherwise(F.col(text))).drop("__best", "__sure")
