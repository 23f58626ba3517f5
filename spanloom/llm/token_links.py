"""Alignment of two tokenizers over a corpus, by inverted bitmaps of token pairs.

Both tokenizers cut the same bytes. Byte offsets where tokens of either end cut a text into segments; each segment lies in
one token of A and one of B, and is the link of these two. Documents are numbered within chunks. For each pair of ids a
chunk has the bitmap of the documents with a link of it (plane 0), and planes of the bits of how many more links a document
has of it. Bitmaps are compressed: a list of places where few bits are set, the bits themselves where many are. A pair's
documents and links are the sums of its planes' popcounts, a plane's bits weighing 1, 1, 2, 4, ...

Then the scores of pairs return along the postings: each chunk's bitmaps say which documents a pair's count goes to, and
how often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import reachable

from .byte_level import byte_level, lengths
from .common import load, slices, stored

#: A chunk's documents, at most: places in it are 16-bit numbers.
CHUNK = 1 << 16
#: Postings (a pair in a document) that a task holds before it closes a chunk.
POSTINGS = 3_000_000
MARK = "▁"


class Pair:
    """The two tokenizers in one worker: a byte-level vocabulary A and a SentencePiece model B, which adds a space in front.

    ``texts`` of ids: for A and B each a list of the id's digits and what follows within a group, and at its end.
    """

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = byte_level(a, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_bytes, self.b_bytes = self.a.spelt(), [self._spelt(i) for i in range(self.b.vocab_size())]
        self.a_sizes, self.b_sizes = lengths(self.a_bytes), lengths(self.b_bytes)
        digits = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.a_text = np.concatenate([digits(na, ","), digits(na, "|")])
        self.b_text = np.concatenate([digits(nb, ","), digits(nb, ";")])

    def _spelt(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both; none where the text is null or empty, or where either's bytes are others than a space and the text."""
        if not text:
            return [], []
        whole, a, b = " " + text, self.a.ids(" " + text), self.b.encode(text)
        wanted = whole.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a)) != wanted or b"".join(map(self.b_bytes.__getitem__, b)) != wanted:
            return [], []
        return a, b


class Links:
    """The links of a batch of texts: for each link its text (number in the batch) and its places in the ids of A and B;
    for each text counts and the digest of its groups."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        both = [pair.ids(t) for t in texts]
        self.n_a, self.n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        self.a, self.b = (np.fromiter((i for x in both for i in x[k]), np.int64, int(n.sum())) for k, n in ((0, self.n_a), (1, self.n_b)))
        a_end, b_end = np.cumsum(pair.a_sizes[self.a]), np.cumsum(pair.b_sizes[self.b])  # texts follow each other, so ends are those of the batch
        ends = np.concatenate([a_end, b_end])
        ends.sort(kind="stable")
        first = np.ones(len(ends), bool)
        first[1:] = ends[1:] != ends[:-1]
        at = ends[first]
        self.at_a, self.at_b = np.searchsorted(a_end, at), np.searchsorted(b_end, at)
        text_end = np.concatenate([[0], a_end])[np.cumsum(self.n_a)]
        self.text = np.searchsorted(text_end, at)
        shared = np.diff(np.append(np.flatnonzero(first), len(ends))) == 2
        self.n_links = np.bincount(self.text, minlength=len(texts))
        self.n_groups = np.bincount(self.text[shared], minlength=len(texts))
        self._digests(pair, np.searchsorted(at[shared], a_end), np.searchsorted(at[shared], b_end))

    def _digests(self, pair: Pair, a_group: np.ndarray, b_group: np.ndarray) -> None:
        """Groups as text: ids of A by commas, a bar, ids of B by commas, groups by semicolons."""
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        n, a_before, b_before = len(a_group) + len(b_group), np.searchsorted(b_group, a_group), np.searchsorted(a_group, b_group, side="right")
        parts = np.empty(n, object)
        parts[np.arange(len(a_group)) + a_before] = pair.a_text[self.a + len(pair.a_bytes) * last(a_group)]
        parts[np.arange(len(b_group)) + b_before] = pair.b_text[self.b + len(pair.b_bytes) * last(b_group)]
        flat, at, self.digests = parts.tolist(), 0, []
        for size in (self.n_a + self.n_b).tolist():
            self.digests.append(hashlib.sha256("".join(flat[at : at + size])[:-1].encode()).hexdigest() if size else "")
            at += size

    def postings(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, how often) of the pairs in each document: ids of A and B and the document's place, in one number each."""
        return np.unique(self.a[self.at_a] << 40 | self.b[self.at_b] << 16 | (self.text + first), return_counts=True)


def planes(keys: np.ndarray, times: np.ndarray, documents: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(plane, pairs, starts, data, dense) for each plane of a chunk's postings, which are sorted by pair and place.

    ``data`` holds the bitmaps one after the other, pair k's from starts[k] on: 16-bit places, or where ``dense`` the bits.
    """
    more = times - 1
    for plane in range(int(more.max(initial=0)).bit_length() + 1):
        chosen = keys if plane == 0 else keys[more >> (plane - 1) & 1 == 1]
        pairs, first, counts = np.unique(chosen >> 16, return_index=True, return_counts=True)
        places = (chosen & 0xFFFF).astype("<u2")
        size = -(-documents // 8)
        dense = counts * 2 > size
        sizes = np.where(dense, size, counts * 2)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.zeros(int(starts[-1]), np.uint8)
        sparse = np.repeat(~dense, counts)
        to = np.repeat(starts[:-1] - 2 * first, counts)[sparse] + 2 * np.flatnonzero(sparse)
        low = places[sparse]
        data[to], data[to + 1] = low & 0xFF, low >> 8
        for k in np.flatnonzero(dense).tolist():
            bits = np.zeros(size * 8, bool)
            bits[places[first[k] : first[k] + counts[k]]] = True
            data[starts[k] : starts[k + 1]] = np.packbits(bits, bitorder="little")
        yield plane, pairs, starts, data, dense


def opened(data: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, place) of every bit that is set in the bitmaps of a batch."""
    sizes = np.diff(starts)
    count = np.where(dense, 0, sizes // 2)
    of = np.repeat(np.arange(len(count)), count)
    at = starts[:-1][of] + 2 * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    bitmaps, places = [of], [data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8]
    for k in np.flatnonzero(dense).tolist():
        there = np.flatnonzero(np.unpackbits(data[starts[k] : starts[k + 1]], bitorder="little"))
        bitmaps.append(np.full(len(there), k))
        places.append(there)
    return np.concatenate(bitmaps), np.concatenate(places)


def weight(plane: Column) -> Column:
    return F.when(plane == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))


def inverted(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", postings: int = POSTINGS) -> tuple[DataFrame, DataFrame]:
    """(documents, bitmaps), from one pass over the texts.

    documents: doc_id, chunk, place, n_a, n_b, n_groups, n_links, groups_sha256; bitmaps: chunk, a, b, plane, dense, bits.
    A chunk has CHUNK documents at most and closes earlier when its postings exceed ``postings``; batches' postings are
    OR-merged when it closes.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, chunk bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a int, b int, plane int, dense boolean, bits binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk = Pair(a, b), TaskContext.get().partitionId() << 32
        place, held, key_kind = 0, [], None

        def rows(n: int, **columns) -> pa.RecordBatch:
            kinds = {"doc_id": key_kind, "place": pa.int32(), "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(), "dense": pa.bool_(), "bits": pa.binary()}
            out = [columns[c] if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names]
            return pa.RecordBatch.from_arrays(out, names=names)

        def close() -> Iterator[pa.RecordBatch]:
            keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            for plane, pairs, starts, data, dense in planes(keys[order], times[order], place):
                for k in range(0, len(pairs), 20_000):  # batches of bounded size
                    p, s = pairs[k : k + 20_000], starts[k : k + 20_001]
                    bits = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer((s - s[0]).astype(np.int32)), pa.py_buffer(data[s[0] : s[-1]])])
                    yield rows(len(p), chunk=pa.array(np.full(len(p), chunk)), a=pa.array((p >> 24).astype(np.int32)), b=pa.array((p & 0xFFFFFF).astype(np.int32)), plane=pa.array(np.full(len(p), plane, np.int32)), dense=pa.array(dense[k : k + 20_000]), bits=bits)

        for batch in slices(batches, 256):
            key_kind = batch.schema.field("doc_id").type
            if held and (place + batch.num_rows > CHUNK or sum(len(k) for k, _ in held) > postings):
                yield from close()
                chunk, place, held = chunk + 1, 0, []
            found = Links(pair, batch.column("text").to_pylist())
            places = np.arange(place, place + batch.num_rows)
            yield rows(
                batch.num_rows, doc_id=batch.column("doc_id"), chunk=pa.array(np.full(batch.num_rows, chunk)), place=pa.array(places.astype(np.int32)), n_a=pa.array(found.n_a), n_b=pa.array(found.n_b),
                n_groups=pa.array(found.n_groups), n_links=pa.array(found.n_links), groups_sha256=pa.array(found.digests, pa.string()),
            )
            held.append(found.postings(place))
            place += batch.num_rows
        if held:
            yield from close()

    reachable(docs.sparkSession)
    both = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields))
    return both.where("plane IS NULL").select(*names[:8]), both.where("plane IS NOT NULL").select("chunk", *names[8:])


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links, best: in how many documents a pair of ids is linked, how often in all, and whether no other
    pair of its b is linked more often. Popcounts are summed in the tasks that read the bitmaps, then by pair."""
    bits = F.when(F.col("dense"), F.bitmap_count("bits")).otherwise(F.octet_length("bits") / 2).cast("long")
    counts = bitmaps.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, bits).otherwise(0)).alias("n_docs"), F.sum(bits * weight(F.col("plane"))).alias("n_links"))
    counts = stored(counts)
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def returned(bitmaps: DataFrame, counts: DataFrame) -> DataFrame:
    """chunk, place, n_best, count_sum of every document with links.

    A pair's score goes to the chunks that have it as a narrow row, then stands before its bitmaps; bitmaps are dealt by
    chunk, not by pair, so frequent pairs gather nowhere.
    """
    here = bitmaps.where("plane = 0").select("chunk", "a", "b")
    score = here.join(counts.select("a", "b", "n_links", "best").hint("rebalance"), ["a", "b"])
    before = score.select("chunk", "a", "b", F.lit(-1).alias("plane"), F.lit(False).alias("dense"), F.lit(None).cast("binary").alias("bits"), "n_links", "best")
    none = bitmaps.select("chunk", "a", "b", "plane", "dense", "bits", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("boolean").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, links, best, sums = None, 0, False, np.zeros((2, CHUNK), np.int64)

        def out() -> pa.RecordBatch:
            there = np.flatnonzero(sums[1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), chunk)), pa.array(there.astype(np.int32)), pa.array(sums[0, there]), pa.array(sums[1, there])], names=["chunk", "place", "n_best", "count_sum"])

        for whole in batches:
            chunks = whole.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                if chunks[at] != chunk:
                    if chunk is not None:
                        yield out()
                    chunk = int(chunks[at])
                    sums[:] = 0
                b = whole.slice(at, end - at)
                plane = b.column("plane").to_numpy()
                heads = np.flatnonzero(plane < 0)
                # scores by head, that of the batch before at the front
                all_links = np.append(links, b.column("n_links").take(pa.array(heads)).to_numpy(zero_copy_only=False))
                all_best = np.append(best, b.column("best").take(pa.array(heads)).to_numpy(zero_copy_only=False).astype(bool))
                links, best = int(all_links[-1]), bool(all_best[-1])
                rows = np.flatnonzero(plane >= 0)
                head = np.searchsorted(heads, rows)
                bits = pa.concat_arrays([b.column("bits").take(pa.array(rows))])
                starts = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
                data = np.frombuffer(bits.buffers()[2], np.uint8) if bits.buffers()[2] is not None else np.zeros(0, np.uint8)
                of, place = opened(data, starts, b.column("dense").take(pa.array(rows)).to_numpy(zero_copy_only=False))
                times = np.where(plane[rows] == 0, 1, np.int64(1) << np.maximum(plane[rows] - 1, 0))
                np.add.at(sums[0], place, (times * all_best[head])[of])
                np.add.at(sums[1], place, (times * all_links[head])[of])
        if chunk is not None:
            yield out()

    dealt = before.unionByName(none).repartition("chunk").sortWithinPartitions("chunk", "a", "b", "plane")
    return dealt.mapInArrow(run, "chunk bigint, place int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per document.

    Texts null or empty, or that either tokenizer doesn't give back, have no tokens: zeros, and an empty digest. Each row
    is a document, however often it recurs, and counts as often; null ids stay null. A table without rows gives none;
    other columns are left out.
    """
    documents, bitmaps = inverted(docs, a or default_a(), b or default_b(), doc_id, text, postings)
    scores = returned(bitmaps, stored(pair_counts(bitmaps)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return documents.join(scores, ["chunk", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level vocabulary and the piece model over all documents."""
    return align(load(spark, sf_dir, "documents"))
