"""The trie of conversations that begin alike, and its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is a hash chain over the turns, so nodes of all conversations meet
by key. Totals over subtrees take a number of join rounds that grows with the logarithm of the tree, not with its depth.
A round rakes all leaves: their totals are known and go to their parents. Then it compresses chains of nodes with one
child: of neighbours in a chain those with the lowest rank go, their child takes their parent and what they hold. When
only the root is left, the compressed nodes are expanded in the opposite order: each one's total is that of its child,
which is known by then, and what it held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.tables import reachable

from .common import Scratch, load, stored

#: The root's key.
ROOT = bytes(16)
#: Conversations whose ids are written out in one go.
RUN = 1 << 16


def rebuilt(rows: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, place, said (a hash of role and text), n_bytes (of the text) of the turns of every
    rebuilt conversation, and all conv_ids.

    Conversation c gets the first h turns of conversation c - c % ``every`` (% as in SQL, with the sign of c), where h is
    crc32(decimal c) % ``heads``, and then its own without its first h. Turns are ordered by turn (null first), then role,
    then text by their bytes (null as empty), so that ties don't matter and repeated rows stay. Rows whose conv_id is null
    belong to no conversation. Texts cross one shuffle, then their hashes stand for them.
    """
    plain = rows.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = stored(plain.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), F.substring(F.unhex(digest), 1, 16).alias("said"), F.octet_length("text").cast("long").alias("n_bytes")))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = own.where("place = 0").select("conv_id")
    wanted = convs.select(F.col("conv_id").alias("to"), taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("conv_id"))
    lent = own.where(F.col("place") < heads - 1).join(wanted, "conv_id").where("place < h").select(F.col("to").alias("conv_id"), "place", "said", "n_bytes")
    return lent.unionByName(own.where(F.col("place") >= taken)), convs


def steps(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, n_bytes, ends, run: a row for each node on each conversation's way from the root.

    ``ends`` marks the last one; runs number the ways in order of conv_id, RUN or fewer a run. Conversations are dealt by
    ranges of conv_id and pass through in order, so none is held, however long.
    """
    kind = convs.schema["conv_id"].dataType.simpleString()
    begun = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("n_bytes"))
    names = ["conv_id", "depth", "node", "parent", "n_bytes", "ends", "run"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, met, node, depth, last, key = TaskContext.get().partitionId() << 32, 0, ROOT, 0, None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [key, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            key, out = b.schema.field("conv_id").type, []
            for conv, place, said, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "said", "n_bytes")), strict=True):
                above = None
                if place < 0:
                    run += met > 0 and met % RUN == 0
                    met, depth, node = met + 1, 0, ROOT
                else:
                    above, depth, node = node, depth + 1, hashlib.blake2b(node + said, digest_size=16).digest()
                if last is not None:
                    out.append((*last[:5], place < 0, last[5]))
                last = (conv, depth, node, above, n, run)
            if out:
                yield batch(out)
        if last is not None:
            yield batch([(*last[:5], True, last[5])])

    reachable(turns.sparkSession)
    way = turns.unionByName(begun).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "place")
    return way.mapInArrow(walk, f"conv_id {kind}, depth bigint, node binary, parent binary, n_bytes bigint, ends boolean, run bigint")


def end_digests(way: DataFrame) -> DataFrame:
    """node, ends_sha256 for nodes at which conversations end: the digest of their ids in order, joined by commas.

    Ids of a run are written out together; then a node's runs pass through in order, so a node where a third of all
    conversations end comes in few rows and is never held.
    """
    written = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    runs = way.where("ends").groupBy("node", "run").agg(written.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

        for b in batches:
            out = []
            for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if node == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield batch(out)
        if now is not None:
            yield batch([(now, digest.hexdigest())])

    return runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def _rank(depth: Column) -> Column:
    """Of a chain node: how often two divides its depth, then the depth. In a chain of consecutive depths every other one
    has a lower rank than both its neighbours, and so on in what is left."""
    return F.struct(F.bit_count(depth.bitwiseAND(-depth) - 1).alias("twos"), depth.alias("depth"))


def subtree_totals(tree: DataFrame, values: list[str], most_rounds: int = 200) -> DataFrame:
    """node and, for each of ``values`` (longs), the sum over the node's subtree, the node included.

    ``tree``: node, parent (null for a root), depth (greater than the parent's) and the values; one row per node, every
    parent a node. It may hold several trees. Rounds are written tables, so the plans stay short. Raises if
    ``most_rounds`` don't suffice: they suffice for any tree of fewer than two to that many nodes, chains or not.
    """
    own, up = [F.col(v) for v in values], [f"up_{v}" for v in values]
    none = F.lit(0).cast("long")
    with Scratch() as hold:
        # up_v: what compressed nodes between this node and its present parent held
        alive = hold(tree.select("node", "parent", "depth", *values, *(none.alias(u) for u in up)))
        raked: list[DataFrame] = []
        squeezed: list[DataFrame] = []
        while True:
            kids = alive.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
            marked = stored(alive.join(kids.hint("shuffle_merge"), "node", "left"))
            leaves = marked.where("kids IS NULL")
            raked.append(leaves.select("node", *values))
            given = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("gone"), *(F.sum(F.col(v) + F.col(u)).alias(f"got_{v}") for v, u in zip(values, up, strict=True)))
            inner = marked.where("kids IS NOT NULL").join(given, "node", "left")
            inner = inner.select("node", "parent", "depth", *((F.col(v) + F.coalesce(f"got_{v}", none)).alias(v) for v in values), *up, (F.col("kids") - F.coalesce("gone", none)).alias("kids"))
            last, alive = alive, hold(inner)
            hold.drop(last)
            if alive.isEmpty():
                break
            if len(raked) > most_rounds:
                raise RuntimeError(f"subtree_totals: {most_rounds} rounds did not suffice")
            # chains: nodes with one child each, root excepted; the child's row knows its parent
            chain = alive.where("kids = 1 AND parent IS NOT NULL")
            above = chain.select(F.col("node").alias("parent"), _rank(F.col("depth")).alias("above"), F.col("parent").alias("grand"), *(F.col(v).alias(f"above_{v}") for v in values), *(F.col(u).alias(f"above_{u}") for u in up))
            edges = hold(alive.join(above, "parent", "left").withColumn("mine", F.when((F.col("kids") == 1) & F.col("parent").isNotNull(), _rank(F.col("depth")))))
            # a chain node goes if its rank is below that of its child and of its parent, where these are chain nodes too
            lower = edges.where("above IS NOT NULL AND (mine IS NULL OR above < mine)").select(F.col("parent").alias("node"), F.col("node").alias("child"), "grand", *up)
            go = edges.where("mine IS NOT NULL AND (above IS NULL OR mine < above)").select("node", *values, *(F.col(u).alias(f"own_{u}") for u in up)).join(lower, "node")
            gone = stored(go.select("node", "child", *((F.col(v) + F.col(u)).alias(v) for v, u in zip(values, up, strict=True)), "grand", *((F.col(v) + F.col(f"own_{u}")).alias(f"more_{u}") for v, u in zip(values, up, strict=True))))
            squeezed.append(gone)
            taken = gone.select(F.col("child").alias("node"), F.col("grand").alias("new_parent"), F.lit(True).alias("moved"), *(f"more_{u}" for u in up))
            rest = edges.join(gone.select("node"), "node", "left_anti").join(taken, "node", "left")
            last, alive = alive, hold(rest.select("node", F.when(F.col("moved"), F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), "depth", *values, *((F.col(u) + F.coalesce(f"more_{u}", none)).alias(u) for u in up)))
            hold.drop(last)
            hold.drop(edges)
        known = raked[0]
        for r in raked[1:]:
            known = known.unionByName(r)
        for gone in reversed(squeezed):
            total = known.select(F.col("node").alias("child"), *(F.col(v).alias(f"below_{v}") for v in values))
            known = known.unionByName(stored(gone.join(total, "child").select("node", *((F.col(v) + F.col(f"below_{v}")).alias(v) for v in values))))
    return known


def prefix_trie(rows: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a
    row per node of the rebuilt conversations (see rebuilt). A table without conversations has no nodes, not even a root;
    columns of other names than conv_id, turn, role and text count for nothing."""
    way = stored(steps(*rebuilt(rows, every, heads)))
    nodes = stored(way.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("n_bytes").alias("n_bytes")))
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")
    totals = subtree_totals(nodes.select("node", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), saved), ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "node").join(end_digests(way), "node", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt by fives."""
    return prefix_trie(load(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH own AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (  -- crc32 of the decimal id, eight steps for each of its bytes
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, b:
           list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)
), turns AS (
  SELECT h.c, o.place, o.role, o.text FROM h JOIN own o ON o.c = h.c - h.c % 5 AND o.place < h.h
  UNION ALL SELECT h.c, o.place, o.role, o.text FROM h JOIN own o ON o.c = h.c AND o.place >= h.h
), way AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY place) AS depth, strlen(text) AS n_bytes,
         sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' ) OVER (PARTITION BY c ORDER BY place)) AS node
  FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM h
), step AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS last FROM way
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM step GROUP BY node
), counted AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes GROUP BY parent) k ON k.parent = n.node
), totals AS (  -- a node's ancestors are the nodes on its smallest member's way
  SELECT w.node, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens
  FROM counted n JOIN way w ON w.c = n.conv_id AND w.depth <= n.depth GROUP BY w.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN totals t USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
