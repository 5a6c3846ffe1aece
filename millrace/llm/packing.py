"""Packing token pieces into sequences: exact complements first, best fit for what is left.

Where a piece goes depends on its length alone, so the plan is made from the number of pieces of each length: at most
``capacity`` numbers at the driver, however many pieces there are. The sums of one, two and three lengths are indexed
once; for each length, longest first, the lengths that fill the gap exactly are looked up there under the numbers still
available, and as many sequences as those allow are filled at once. What no exact filling takes is placed best fit, longest first, in groups
of like sequences. The plan says, for the r-th piece of a length, its sequence and place; ranks come from counts by
(part, length) and a running number within a part, so no piece is moved to be counted.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._spark import cut, id_type
from millrace.llm._text import chunks
from millrace.llm.bpe import encoder

CAPACITY = 4096
_PIECE = "piece int, start long, length long, ids_crc32 long"


def _room(available: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How many sequences of these lengths the available pieces make."""
    return min(int(available[x]) // lengths.count(x) for x in set(lengths))


class Sums:
    """Index of the sums of one, two and three of the lengths that there are, under the numbers still available.

    Pairs lie by their sum, the one with the longest member first. Numbers only fall, so a pair of which a member is
    used up is passed for good. A triple's sum is found through its longest member and the index of pairs.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        have = np.flatnonzero(left)
        top = len(left)
        counts = np.zeros(top + 1, np.int64)
        for x in have:  # pairs (x, y) with y <= x
            counts[x + have[(have <= x) & (x + have < top)]] += 1
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.cursor = self.start[:-1].copy()
        self.longer = np.zeros(int(self.start[-1]), np.int16 if top < 1 << 15 else np.int32)
        fill = self.start[:-1].copy()
        for x in have[::-1]:
            sums = x + have[(have <= x) & (x + have < top)]
            self.longer[fill[sums]] = x
            fill[sums] += 1
        self.paired = counts > 0  # sums that may still have a pair

    def pair(self, total: int, others: tuple[int, ...]) -> tuple[int, ...] | None:
        if total < 2 or not self.paired[total]:
            return None
        longer = self.longer[self.cursor[total] : self.start[total + 1]].astype(np.int64)
        alive = np.flatnonzero((self.left[longer] > 0) & (self.left[total - longer] > 0))
        self.paired[total] = len(alive) > 0
        for x in longer[alive].tolist():
            if _room(self.left, (*others, x, total - x)):
                self.cursor[total] += alive[0]
                return *others, x, total - x
        return None

    def fill(self, longest: int, gap: int) -> tuple[int, ...] | None:
        """A piece of the longest with one, two or three available lengths that fill the gap beside it."""
        if _room(self.left, (longest, gap)):
            return longest, gap
        if found := self.pair(gap, (longest,)):
            return found
        third = np.arange(gap - 2, -(-gap // 3) - 1, -1)
        third = third[third > 0]
        for x in third[(self.left[third] > 0) & self.paired[gap - third]].tolist():
            if found := self.pair(gap - x, (longest, x)):
                return found
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); counts[x]: pieces of length x, 0 < x <= capacity."""
    left, out = counts.astype(np.int64).copy(), []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    sums = Sums(left)
    for longest in range(capacity - 1, 0, -1):
        while left[longest] and (found := sums.fill(longest, capacity - longest)):
            m = _room(left, found)
            for x in found:
                left[x] -= m
            out.append((found, m))
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    gaps: list[int] = []

    def add(lengths: tuple[int, ...], m: int, gap: int) -> None:
        if not gap:
            out.append((lengths, m))
            return
        if not groups.setdefault(gap, []):
            insort(gaps, gap)
        groups[gap].append((lengths, m))

    for x in range(capacity - 1, 0, -1):
        n = int(left[x])
        while n:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                fit = capacity // x
                for m, k in ((n // fit, fit), (1, n % fit)):
                    if m and k:
                        add((x,) * k, m, capacity - k * x)
                break
            gap = gaps[at]
            lengths, m = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(at)
            used = min(n, m)
            if m > used:
                add(lengths, m - used, gap)
            add((*lengths, x), used, gap - x)
            n -= used
    return out + [g for gap in gaps for g in groups[gap]]


class Places:
    """The plan as sorted intervals over all pieces, shortest length first."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        slots, base = [], 0
        for lengths, m in plan(counts, capacity):
            offset = 0
            for x in lengths:
                slots.append((x, m, base, offset))
                offset += x
            base += m
        slots.sort(key=lambda s: s[0])
        self.sequences = base
        self.sequence = np.array([s[2] for s in slots], np.int64)
        self.offset = np.array([s[3] for s in slots], np.int64)
        self.until = np.cumsum([s[1] for s in slots], dtype=np.int64) if slots else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], self.until])[:-1]
        self.shorter = np.cumsum(counts) - counts

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.shorter[length] + rank
        slot = np.searchsorted(self.until, at, side="right")
        return self.sequence[slot] + at - self.begin[slot], self.offset[slot]


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and place: the piece's number among those of its length in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, texts in chunks(batches):
            ids, at = bpe.encode(texts)
            full = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            total = np.diff(at)
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(len(texts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(total[doc] - start, capacity)
            begin = at[doc] + start
            raw = memoryview(full.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            order = np.argsort(length, kind="stable")
            number = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(number) - number, number)
            place += seen[length]
            seen += number
            ids_of = rows.column("doc_id").combine_chunks().take(pa.array(doc))
            yield from pa.table({"doc_id": ids_of, "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(doc), part), pa.int32()), "place": place}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, {_PIECE}, part int, place long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs (doc_id, text).

    A null text counts as empty: one piece with the end id. Rows with equal doc_ids are packed as documents of their
    own. An empty table gives no rows. Columns other than doc_id and text are not read. Texts are encoded once; the
    table of pieces is kept in the shared folder, and counts by length go to the driver (at most ``capacity`` rows).
    """
    pieces = cut(cut_pieces(docs, vocabulary, end_id, capacity))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    places = Places(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places(b.column("length").to_numpy(), b.column("base").to_numpy() + b.column("place").to_numpy())
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = pieces.join(bases, ["part", "length"])
    return joined.mapInArrow(run, f"doc_id {id_type(docs)}, {_PIECE}, sequence_id long, offset long")
