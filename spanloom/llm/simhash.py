"""SimHash fingerprints and groups of near duplicates.

Fingerprints of equal texts are equal, so groups are sought among *distinct* fingerprints. A fingerprint is embedded as
the popcounts of its 32 two-bit segments; the Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints. Points within Manhattan distance r agree on all coordinates of at least ``BLOCKS - r`` of BLOCKS blocks
of coordinates, so a grid for each choice of ``BLOCKS - r`` blocks, whose cells hold equal coordinates in them, brings
every such pair together in some cell. Pairs of a cell are then verified on the fingerprints themselves.

Cells with more than ``CELL`` fingerprints are not paired. Two fingerprints differ in at most two bits just if some word
differs from each in at most one; so those of crowded cells emit the 65 words around them and link to the least
fingerprint at each word: 65 rows a fingerprint however many share the cell, and the same components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, folded, free_name, load, split_by, stored, with_columns_from
from .components import components
from .embedding import LOWER, close, embedding
from .jaccard import near_copies

SHINGLE = 3
DISTANCE = 2
BLOCKS = 5
CELL = 64


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, as a signed number. Null and wordless texts have fingerprint zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))
    half = len(shingles) / 2
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 1 << 14):
        h = np.array([digest(s, seed) for s in shingles[at : at + (1 << 14)]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total > half, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (of its other columns those in ``keep``, or all) with ``fp``, the signed fingerprint of column ``text``; a column
    of that name is replaced."""

    def make():
        return lambda texts: [[fingerprint(x) for x in texts]]

    return with_columns_from(df, [text], T.StructType([T.StructField("fp", T.LongType())]), make, keep=keep)


def grids(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks over the embedding, as signed numbers: one for each choice of blocks - distance blocks of fields."""
    edges = [round(k * 32 / blocks) for k in range(blocks + 1)]
    masks = [sum(3 << (2 * f) for f in range(edges[k], edges[k + 1])) for k in range(blocks)]
    whole = [sum(masks[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def links(distinct_fps: DataFrame, hold: Scratch, most: int = CELL) -> DataFrame:
    """Pairs (a, b) of fingerprints with the same components as the graph of all pairs at distance DISTANCE or less.

    ``distinct_fps`` has one column ``fp`` without nulls or repeats, and is read several times. The pairs rest on tables
    in ``hold``.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in grids()])
    cells = distinct_fps.select("fp", F.posexplode(masks).alias("grid", "mask")).select("fp", "grid", embedding(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"))
    shared = hold(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    placed = hold(cells.join(shared, ["grid", "cell"]))
    paired = placed.where(F.col("n") <= most)
    left, right = (paired.select("grid", "cell", F.col("fp").alias(x)) for x in "ab")
    near = left.join(right, ["grid", "cell"]).where((F.col("a") < F.col("b")) & close("a", "b", DISTANCE)).select("a", "b")
    crowded = placed.where(F.col("n") > most).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    around = hold(crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")))
    hubs = around.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    starred = around.join(hubs, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(starred).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: doc_id, copy (hash of the text), fp, root (the group's least fingerprint) and component_id,
    the least doc_id of all rows reachable over links.

    A null doc_id is never the least one unless all of a group are null; equal ids and equal rows stay rows of their
    own. Null and empty texts have fingerprint zero and link like any other.
    """
    plain = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))
    rows = stored(fingerprints(plain, keep=["doc_id", "copy"]))
    with Scratch() as hold:
        known = hold(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
        roots = components(links(known.select("fp"), hold))
        joined = hold(known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
        smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
        groups = stored(joined.join(smallest.hint("rebalance"), "root").select("fp", "root", "component_id"))
    return rows.join(groups, "fp").select("doc_id", "copy", "fp", "root", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies (five-word Jaccard of 0.8 or more, see jaccard) stays,
    that with the least id (ids before null; then by text hash).

    A row that repeats it goes like any other member of the group: of rows with its id and text, the first by all columns
    as JSON stays.
    """
    per_copy = stored(near_copies(docs).groupBy("root", "doc_id", "copy").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy", "n")).alias("first")
    own, copy, n = (free_name(docs, c) for c in ("__doc_id", "__copy", "__n"))
    groups = per_copy.groupBy("root").agg(first, F.count("*").alias("copies"))
    kept = stored(groups.select(F.col("first.doc_id").alias(own), F.col("first.copy").alias(copy), F.col("first.n").alias(n), "root", "copies"))
    # documents that stand alone stay as they are, without a shuffle of their texts; the others are looked up
    touched = per_copy.join(kept.where(F.col("copies") > 1).select("root").hint("rebalance"), "root", "left_semi").select("doc_id", "copy").unionByName(per_copy.where("n > 1").select("doc_id", "copy"))
    asked, untouched = split_by(docs, folded("doc_id", F.xxhash64("text")), touched, folded("doc_id", "copy"))
    # and of those looked up most that go, go before their texts are shuffled
    kept, _ = split_by(kept.drop("root", "copies"), folded(own, copy), touched, folded("doc_id", "copy"))
    kept = stored(kept)
    asked, _ = split_by(asked, folded("doc_id", F.xxhash64("text")), kept, folded(own, copy))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(copy))
    alone = asked.join(kept.where(F.col(n) == 1), same, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = asked.join(kept.where(F.col(n) > 1), same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(copy)).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return untouched.unionByName(alone).unionByName(repeated.select("row.*"))
