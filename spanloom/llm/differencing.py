"""Packing into near-equal windows by multiway differencing (Karmarkar-Karp).

A partial partition deals some pieces to k windows. At first each piece is one of its own; then, again and again, the two
whose windows differ most are merged, the fullest window of one with the emptiest of the other, so that their imbalances
oppose each other. What is left is one partition of all pieces into near-equal windows. While its fullest window exceeds
the capacity, the count of windows rises and the pieces are dealt anew.

Documents may be cut, so what near-equal windows leave open is then settled: as many windows as the tokens fill are filled
up by what the lightest ones hold, and the rest, less than a window, goes to windows of powers of two, which need no
padding. Each task packs blocks of its own documents, a bounded number of tokens at a time; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import reachable

from .byte_level import packed
from .common import load, slices

CAPACITY = 2048
#: Tokens of the longest piece that is dealt to a window: about four of them fill one, so imbalances can be evened out.
GRAIN = 512
#: Tokens that a task packs at a time.
BLOCK = 1 << 20
END = 1  # the id behind each document
Part = tuple[int, int, int]  # document (its number in the block), start, length


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The indexes of the sizes dealt to each window. Every size lies in just one; windows may stay empty.

    Partial partitions hold their nonempty windows only, fullest first: (sums, nodes), where a node is a piece or the
    union of two nodes. ``windows`` entries a merge at most, and one union for each piece.
    """
    if not sizes:
        return [[] for _ in range(windows)]
    order = np.argsort(np.array(sizes, np.int64), kind="stable")[::-1]
    partitions = {k: (np.array([sizes[i]], np.int64), np.array([i], np.int64)) for k, i in enumerate(order.tolist())}
    spread = lambda sums: int(sums[0] - sums[-1]) if len(sums) == windows else int(sums[0])
    heap = [(-spread(sums), k) for k, (sums, _) in partitions.items()]
    heapify(heap)
    unions: list[tuple[int, int]] = []
    while len(heap) > 1:
        (_, one), (_, two) = heappop(heap), heappop(heap)
        (a, a_nodes), (b, b_nodes) = partitions.pop(one), partitions.pop(two)
        free = windows - len(b)  # windows of the first that meet an empty one
        if len(a) <= free:
            sums, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        else:
            met, against = len(a) - free, b_nodes[::-1]
            first = len(sizes) + len(unions)
            unions += zip(a_nodes[free:].tolist(), against[:met].tolist(), strict=True)
            sums = np.concatenate([a[:free], a[free:] + b[::-1][:met], b[::-1][met:]])
            nodes = np.concatenate([a_nodes[:free], np.arange(first, first + met), against[met:]])
        down = np.argsort(-sums, kind="stable")
        partitions[one] = (sums[down], nodes[down])
        heappush(heap, (-spread(partitions[one][0]), one))
    out = []
    for node in partitions[heap[0][1]][1].tolist():
        pieces, stack = [], [node]
        while stack:
            n = stack.pop()
            if n < len(sizes):
                pieces.append(n)
            else:
                stack += unions[n - len(sizes)][::-1]
        out.append(pieces)
    return out + [[] for _ in range(windows - len(out))]


def near_equal(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows within the capacity. Their count begins at the least that the sum allows and rises by the share
    that the fullest window exceeds the capacity, until none does. Sizes above the capacity raise ValueError."""
    if sizes and max(sizes) > capacity:
        raise ValueError("a piece exceeds the capacity")
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, count)
        fullest = max(sum(sizes[i] for i in w) for w in dealt)
        if fullest <= capacity:
            return dealt
        count += max(1, count * (fullest - capacity) // capacity)


def settle(windows: list[list[Part]], capacity: int = CAPACITY) -> list[list[Part]]:
    """Windows without padding: as many full ones as there are tokens for, and the rest in windows of powers of two.

    The lightest windows, one for each that the tokens don't fill, are opened. Each of the others gives its longest piece
    to those opened and takes, in one go, what that piece and its room hold: so no sliver of a piece fills the room.
    """
    load = lambda w: sum(n for _, _, n in w)
    full, rest = divmod(sum(map(load, windows)), capacity)
    by_load = sorted(windows, key=load, reverse=True)
    kept, pool = by_load[:full], deque(p for w in by_load[full:] for p in w)

    def take(tokens: int) -> list[Part]:
        got = []
        while tokens:
            doc, start, n = pool.popleft()
            if n > tokens:
                pool.appendleft((doc, start + tokens, n - tokens))
                n = tokens
            got.append((doc, start, n))
            tokens -= n
        return got

    out = []
    for w in kept:
        if room := capacity - load(w):
            given = max(w, key=lambda p: p[2])
            w = [p for p in w if p is not given]
            pool.append(given)
            w += take(room + given[2])
        out.append(joined(w))
    return out + [joined(take(1 << bit)) for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def joined(parts: list[Part]) -> list[Part]:
    """Parts by document and start; those that follow each other are one."""
    out: list[Part] = []
    for doc, start, n in sorted(parts):
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == start:
            out[-1] = (doc, out[-1][1], out[-1][2] + n)
        else:
            out.append((doc, start, n))
    return out


def pieces(doc: int, tokens: int, capacity: int, grain: int) -> tuple[list[Part], list[Part]]:
    """A document's full windows, and what is left of it in equal pieces of at most ``grain`` tokens."""
    whole = [(doc, at, capacity) for at in range(0, tokens - capacity + 1, capacity)]
    at, left = len(whole) * capacity, tokens % capacity
    count = -(-left // grain)
    cuts = [at + left * k // count for k in range(count + 1)] if count else []
    return whole, [(doc, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def pack_evenly(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", grain: int = GRAIN, block: int = BLOCK, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of every document.

    A document is the ids of its text (null or empty: none), then ``end``. Each row is a document, however often it
    recurs, and null ids stay null. Sequence ids are the task's number and a count within it, so they don't depend on
    which executor runs a task, or how often. A table without rows gives none; other columns are left out.
    """
    kind, path = docs.schema[doc_id].dataType.simpleString(), vocabulary or default_vocabulary()
    if capacity < 1 or capacity & (capacity - 1) or not 0 < grain <= capacity:
        raise ValueError("the capacity must be a power of two, and the grain at most that")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = packed(path), np.array([end], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []  # ids of the block's documents
        ids: list[bytes] = []
        whole: list[Part] = []
        loose: list[Part] = []
        held = 0

        def packed_block() -> pa.RecordBatch:
            nonlocal sequence
            dealt = near_equal([n for _, _, n in loose], capacity) if loose else []
            windows = [[w] for w in whole] + settle([[loose[i] for i in w] for w in dealt], capacity)
            rows, out = [], []
            for w in windows:
                at = 0
                for doc, start, n in w:
                    rows.append(doc)
                    out.append((start, n, zlib.crc32(memoryview(ids[doc])[4 * start : 4 * (start + n)]), len(ids[doc]) // 4, sequence, at))
                    at += n
                sequence += 1
            taken = pa.concat_arrays(keys).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([taken, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=names)

        for b in slices(batches, 256):
            texts, key, from_ = b.column("text").to_pylist(), b.column("doc_id"), 0
            for r, value in enumerate(texts):
                doc = encode(value or "") + tail
                full, left = pieces(len(ids), len(doc) // 4, capacity, grain)
                ids.append(doc)
                whole += full
                loose += left
                held += len(doc) // 4
                if held >= block:
                    keys.append(key.slice(from_, r + 1 - from_))
                    from_ = r + 1
                    yield packed_block()
                    keys, ids, whole, loose, held = [], [], [], [], 0
            if from_ < len(texts):
                keys.append(key.slice(from_))
        if ids:
            yield packed_block()

    reachable(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_even_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 2048 tokens."""
    return pack_evenly(load(spark, sf_dir, "documents"))
