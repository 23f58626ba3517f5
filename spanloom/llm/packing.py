"""Best-fit packing of documents into token sequences by bin completion.

Only the *number* of pieces of each length matters to a packing, so the search runs on a histogram with at most
``capacity`` entries, whatever the input holds. ``search`` fills one bin at a time around the largest piece left:
it enumerates the undominated fillings of the rest, takes the one with least waste as often as the histogram allows, and
goes back to the other fillings and to fewer bins of them where the waste rules out a better packing. A best-fit packing
of the same histogram is the first incumbent: where it meets the lower bound it is returned as it is.

Pieces are then matched with places: each gets its rank among the pieces of its length (a per-task rank plus an offset
per task and length), and the place table says where pieces of that length and rank go. Token ids never cross a shuffle.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.sources.tables import reachable

from .common import load, slices, stored
from .wordpiece_cache import ids_of

CAPACITY = 2048
BATCH = 400  # steps
Fillings = list[tuple[tuple[int, ...], int]]


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Fillings:
    """Best-fit decreasing over lengths: (filling, how many bins) pairs. Equal bins stay together as one entry."""
    groups: dict[int, list[list]] = defaultdict(list)  # room left: [filling, bins]
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                per = capacity // length
                filling, bins, room = (), max(1, left // per), capacity
            fit = max(1, min(room // length, left // bins)) if left >= bins else 1
            used = min(bins, left)
            if used < bins:
                _put(groups, rooms, room, filling, bins - used)
            _put(groups, rooms, room - fit * length, filling + (length,) * fit, used)
            left -= used * fit
    return [(filling, bins) for entries in groups.values() for filling, bins in entries]


def _put(groups: dict[int, list[list]], rooms: list[int], room: int, filling: tuple[int, ...], bins: int) -> None:
    if room not in groups:
        bisect.insort(rooms, room)
    groups[room].append([filling, bins])


def fillings(counts: dict[int, int], room: int, most_waste: int | None = None) -> Iterator[tuple[int, tuple[tuple[int, int], ...]] | None]:
    """Undominated fillings of ``room``: (waste, (length, how many) pairs), and a None for every other step of the search.

    Depth-first, longest pieces first and as many as fit first; all pieces of a length are one step. Out are branches
    that must waste more than ``most_waste``, and dominated leaves: those that leave space for a piece still there, or
    for a longer one in the place of one of theirs. An exchange of the two pieces shows that nothing is lost by that.
    """
    lengths = [x for x in sorted(counts) if counts[x] and x <= room]
    upto_sum = [0, *accumulate(x * counts[x] for x in lengths)]
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(room, len(lengths), ())]
    while stack:
        left, upto, chosen = stack.pop()
        end = bisect.bisect_right(lengths, left, 0, upto)
        if most_waste is not None and left - upto_sum[end] > most_waste:
            yield None
            continue
        if end:
            longest = lengths[end - 1]
            stack.append((left, end - 1, chosen))  # without it: last
            stack += [(left - n * longest, end - 1, (*chosen, (longest, n))) for n in range(1, min(left // longest, counts[longest]) + 1)]
            yield None
            continue
        used = dict(chosen)

        def free(low: int, high: int) -> bool:
            """Whether a piece longer than low and up to high is left over."""
            return any(used.get(x, 0) < counts[x] for x in lengths[bisect.bisect_right(lengths, low) : bisect.bisect_right(lengths, high)])  # noqa: B023

        yield None if free(0, left) or left and any(free(x, x + left) for x in used) else (left, chosen)


def least_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound of the number of bins: pieces over half the capacity need bins of their own, and with those of at
    least ``small`` the volume that does not fit beside them needs more; the best over all ``small``, 0 included."""
    lengths = sorted(x for x, n in histogram.items() if n > 0)
    best = -(-sum(x * histogram[x] for x in lengths) // capacity)
    for small in [x for x in lengths if 2 * x <= capacity]:
        alone = sum(histogram[x] for x in lengths if x > capacity - small)
        half = [x for x in lengths if capacity - small >= x > capacity // 2]
        halves = sum(histogram[x] for x in half)
        beside = halves * capacity - sum(x * histogram[x] for x in half)
        rest = sum(x * histogram[x] for x in lengths if small <= x <= capacity // 2)
        best = max(best, alone + halves + max(0, -(-(rest - beside) // capacity)))
    return best


@dataclass(frozen=True)
class Packing:
    """fillings: (filling, number of bins) pairs; bound: no packing has fewer bins; proven: none has fewer than this one."""

    fillings: Fillings
    bins: int
    bound: int
    proven: bool


def search(histogram: dict[int, int], capacity: int = CAPACITY, most_steps: int | None = 400_000) -> Packing:
    """A packing of all pieces; never more bins than best-fit decreasing.

    Branch-and-bound: a level fills the bin of the largest piece left, with each undominated filling in turn (in batches
    of some hundred steps, by waste within a batch), and each from as often as the pieces allow down to once. Where the
    waste so far shows that no packing better than the best one known can follow, the search goes back to the last level
    with a choice left. Reaching ``least_bins`` ends it, and so do ``most_steps`` steps, with the best packing found by
    then; with None it runs until the packing is proven best.
    """
    counts = {k: v for k, v in histogram.items() if v > 0}
    if any(k > capacity or k < 1 for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    incumbent = best_fit(counts, capacity)
    bins_known = sum(b for _, b in incumbent)
    total = sum(k * v for k, v in counts.items())
    need = least_bins(counts, capacity)
    taken: list[tuple[int, dict[int, int], int]] = []
    bins = waste = steps = 0

    def slack() -> int:
        """Waste that a better packing could still have."""
        return (bins_known - 1) * capacity - total - waste

    def choices() -> Iterator[tuple[int, dict[int, int], int] | None]:
        """Waste a bin, pieces by length, and number of bins of each way to fill the next bins; None for a step without one."""
        first = max(x for x, n in counts.items() if n)
        found: list = []
        for k, leaf in enumerate(fillings(counts | {first: counts[first] - 1}, capacity - first, slack())):
            if leaf is not None:
                found.append(leaf)
            if k % BATCH == BATCH - 1 and found:
                yield from ways(first, found)
                found = []
            yield None
        yield from ways(first, found)

    def ways(first: int, found: list) -> Iterator[tuple[int, dict[int, int], int]]:
        for spare, filling in sorted(found, key=lambda x: x[0]):
            uses = dict(filling)
            uses[first] = uses.get(first, 0) + 1
            most = min(counts[x] // n for x, n in uses.items())
            for times in range(most, 0, -1):
                yield spare, uses, times

    def undo() -> None:
        nonlocal bins, waste
        spare, uses, times = taken.pop()
        bins, waste = bins - times, waste - spare * times
        for x, n in uses.items():
            counts[x] += n * times

    end = object()
    levels = [choices()] if counts else []
    while levels and bins_known > need and (most_steps is None or steps < most_steps):
        steps += 1
        choice = next(levels[-1], end)
        if choice is end or slack() < 0:
            levels.pop()
            if taken:
                undo()
            continue
        if choice is None:
            continue
        spare, uses, times = choice
        if spare * times > slack():
            continue
        taken.append(choice)
        bins, waste = bins + times, waste + spare * times
        for x, n in uses.items():
            counts[x] -= n * times
        if any(counts.values()):
            levels.append(choices())
            continue
        if bins < bins_known:
            bins_known = bins
            incumbent = [(tuple(x for x in sorted(u, reverse=True) for _ in range(u[x])), t) for _, u, t in taken]
        undo()
    return Packing(incumbent, bins_known, need, bins_known <= need or not levels)


def complete(histogram: dict[int, int], capacity: int = CAPACITY, most_steps: int | None = 400_000) -> Fillings:
    """The fillings of ``search``."""
    return search(histogram, capacity, most_steps).fillings


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, the task and the rank among the task's pieces of equal
    length, and, with ``with_ids``, ids (little-endian unsigned 32-bit). A document is its ids and then end_id.

    Null text counts as empty: one piece with end_id only. Rows with one id are documents of their own.
    """
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * with_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(vocabulary)
        seen: dict[int, int] = defaultdict(int)
        task = TaskContext.get().partitionId()
        for b in slices(batches, 64):
            row, out = [], []
            for r, value in enumerate(b.column("text").to_pylist()):
                whole = encode(value or "") + end
                for k, at in enumerate(range(0, len(whole) // 4, capacity)):
                    part = whole[4 * at : 4 * (at + capacity)]
                    n = len(part) // 4
                    row.append(r)
                    out.append((k, at, n, zlib.crc32(part), task, seen[n], part))
                    seen[n] += 1
            columns = zip(kinds, zip(*out, strict=True), strict=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, k) for k, c in columns)], names=names)

    reachable(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint" + ", ids binary" * with_ids
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length, task, rank; see tokenize) with sequence_id and offset.

    Pieces are read twice, so they must be stored. Histogram: at most ``capacity`` rows reach the driver. The place
    table that tasks get has an entry per length and filling, bounded by the capacity too; the offsets (a row per task
    and length) grow with the input and are joined by a shuffle of the pieces' few columns. Any rows may be equal.
    """
    spark = reachable(pieces.sparkSession)
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = stored(per_task.select("task", "length", "n", (before - F.col("n")).alias("before")))
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length: first rank, first sequence, offset, bins
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for filling, bins in complete(histogram, capacity):
        at = 0
        for n in filling:
            places[n].append((ranks[n], sequence, at, bins))
            ranks[n] += bins
            at += n
        sequence += bins
    tables = spark.sparkContext.broadcast({n: np.array(x, np.int64) for n, x in places.items()})
    kept = [c for c in pieces.columns if c not in ("task", "rank", "sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables.value
        for b in batches:
            lengths, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            to, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                t = table[int(lengths[group[0]])]
                row = t[np.searchsorted(t[:, 0], rank[group], side="right") - 1]
                to[group], off[group] = row[:, 1] + rank[group] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(to), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    ranked = pieces.join(offsets.select("task", "length", "before").hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*kept).schema)
    return ranked.select(*kept, "rank").mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of every document."""
    pieces = stored(tokenize(docs, vocabulary or default_vocabulary(), capacity, with_ids=False))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    return pack_documents(load(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what the documents left are packed into: pack_documents of them.

    Null and empty texts are one token (the end id). Each row is a document, however often it recurs; null ids stay null.
    Pieces of equal length are interchangeable, so ties decide only which sequence a piece lies in. No rows give none.
    """
    return pack_documents(docs)
