"""Winnowing fingerprints of whole texts, and the likeness of texts by them.

All k-grams of a text's code points are hashed (32 bits of a rolling hash, for k of at most 64); of every window of w k-grams the smallest
hash is chosen, of equal ones the rightmost, with its position. So any passage of at least w + k - 1 code points that
two texts share gives them a hash in common, and no match shorter than k is seen. A text of fewer than k code points
has one gram, the whole text; one of fewer than w grams has one window; an empty text has no fingerprint.

Likeness is the share of distinct chosen hashes that two texts have in common (two empty texts: 1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import GramHash, chunks, code_points, ragged

GRAM = 16
WINDOW = 32
_LAST = np.uint64(0xFFFFFFFF)


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen hashes (uint32) and positions of all texts end to end, and where each text's start (one more entry)."""
    c, offsets = code_points(texts)
    size = np.diff(offsets)
    grams = np.where(size >= gram, size - gram + 1, np.minimum(size, 1))
    if not grams.sum():
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first = np.cumsum(grams) - grams
    start = ragged(grams, offsets[:-1])
    end = np.minimum(start + gram, np.repeat(offsets[1:], grams))
    h = GramHash(c)(start, end) >> np.uint64(32)
    place = (start - np.repeat(offsets[:-1], grams)).astype(np.uint64)
    rank = h << np.uint64(32) | _LAST - place  # smallest hash first, then rightmost
    least, span = rank, 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    windows = np.where(grams >= window, grams - window + 1, np.minimum(grams, 1))
    begin = np.cumsum(windows) - windows
    chosen = np.empty(int(windows.sum()), np.uint64)
    full = grams >= window
    chosen[ragged(windows[full], begin[full])] = least[ragged(windows[full], first[full])]
    part = np.flatnonzero(~full & (grams > 0))
    if len(part):
        inner = rank[ragged(grams[part], first[part])]
        chosen[begin[part]] = np.minimum.reduceat(inner, np.cumsum(grams[part]) - grams[part])
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = chosen[1:] != chosen[:-1]
    fresh[begin[windows > 0]] = True
    kept = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    chosen = chosen[fresh]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_LAST - (chosen & _LAST)).astype(np.int64), kept[np.append(begin, len(fresh))]


def _owned(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct (text, hash), as one number each."""
    return np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64) << np.uint64(32) | hashes)


def _likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n pairs of sets of distinct (pair, hash)."""
    count = lambda x: np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)[:n]
    both = count(np.intersect1d(a, b, assume_unique=True))
    either = count(a) + count(b) - both
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def _digests(hashes: np.ndarray, places: np.ndarray, at: np.ndarray) -> list[str]:
    raw = memoryview(np.stack([hashes.astype("<i8"), places.astype("<i8")], axis=1).tobytes())
    return [xxhash.xxh3_128_hexdigest(raw[16 * i : 16 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def fingerprint(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<long>, places array<long> of every row of docs (doc_id, text); null texts: empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            hashes, places, at = winnow(texts, gram, window)
            at = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (hashes, places)]
            yield from pa.table({"doc_id": rows.column("doc_id"), "hashes": lists[0], "places": lists[1]}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes array<long>, places array<long>")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, look: rows dealt into parts by ranges of doc_id and sorted there, one shuffle of the texts.

    The first document of each part is also sent to the part before it (that of the first part to the last), at its end
    and with look true, so the document that follows any row is the next row of its task. Range borders are quantiles
    of doc_id; they and the first doc_id of each part, one number a part, are all that the driver sees.
    """
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id"), F.lit(lowest))
    borders = np.array(sorted(set(docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 1 / (2 * parts)))), float)

    def part_of(ids: pd.Series) -> np.ndarray:
        return np.searchsorted(borders, ids.to_numpy(float), side="right")

    @F.pandas_udf("int")
    def own(ids: pd.Series) -> pd.Series:
        return pd.Series(part_of(ids).astype(np.int32))

    firsts = sorted(docs.select(key.alias("k")).select("k", own("k").alias("part")).groupBy("part").agg(F.min("k")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def both(ids: pd.Series) -> pd.Series:
        return pd.Series([[p, before[i]] if i in before else [p] for i, p in zip(ids.tolist(), part_of(ids).tolist())])

    dealt = docs.select("doc_id", "text", key.alias("k")).select("doc_id", "text", F.posexplode(both("k")).alias("look", "part"))
    return dealt.repartition("part").sortWithinPartitions("part", "look", "doc_id", "text").select("doc_id", "text", (F.col("look") == 1).alias("look"))


def compare_edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in ascending doc_id (after the last: the first); near_* are likenesses to it and to the next document.
    Fingerprints are digests of the chosen hashes with their places. A null text is empty, null doc_ids come first,
    rows with equal doc_ids are ordered by text and lie in one task, a table of one row is followed by itself, an empty
    one gives no rows. Very long texts are read whole. doc_ids are longs. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(ids: list, looks: list, texts: list[str]) -> pa.Table:
        """Of all rows but the last, which is only looked at."""
        n = len(texts) - 1
        edited = []
        for t, follows in zip(texts, texts[1:]):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + follows[:half])
        hashes, places, at = winnow(texts, gram, window)
        new_hashes, new_places, new_at = winnow(edited, gram, window)
        own, changed = _owned(hashes, at), _owned(new_hashes, new_at)
        mine = own[: np.searchsorted(own, np.uint64(n) << np.uint64(32))]
        follow = own[np.searchsorted(own, np.uint64(1) << np.uint64(32)) :] - (np.uint64(1) << np.uint64(32))
        out = pa.table(
            {
                "doc_id": pa.array(ids[:n], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": _digests(hashes, places, at)[:n],
                "edited_fingerprint": _digests(new_hashes, new_places, new_at),
                "near_edited": _likeness(mine, changed, n),
                "near_next": _likeness(mine, follow, n),
            }
        )
        return out.filter(pa.array([not x for x in looks[:n]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for rows, texts in chunks(batches):
            ids, looks = rows.column("doc_id").to_pylist(), rows.column("look").to_pylist()
            if held:
                ids, looks, texts = [held[0], *ids], [held[1], *looks], [held[2], *texts]
            held = ids[-1], looks[-1], texts[-1]
            if len(texts) > 1:
                yield from work(ids, looks, texts).to_batches()

    return in_order(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
