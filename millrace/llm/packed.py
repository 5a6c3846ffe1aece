"""Questions and answers between blocks of texts and shards of keys: sorted keys, counts and runs in few bytes."""

from __future__ import annotations

import numpy as np


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as the first one and differences, of as many bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    wide = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([wide]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    wide = blob[8]
    columns = np.frombuffer(blob, np.uint8, offset=9).reshape(wide, -1)
    raw = np.zeros((columns.shape[1] + 1, 8), np.uint8)
    raw[0] = np.frombuffer(blob[:8], np.uint8)
    raw[1:, :wide] = columns.T
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow as places and values."""
    big = np.flatnonzero(counts >= 255)
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + np.stack([big, counts[big]]).astype("<i8").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    big = np.frombuffer(blob, "<i8", offset=8 + n).reshape(2, -1)
    out[big[0]] = big[1]
    return out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def borders(shards: int, bits: int) -> np.ndarray:
    """Where the ranges of keys of ``bits`` bits begin, but for the first."""
    return np.array([(i << bits) // shards for i in range(1, shards)], np.uint64)


def sent(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys are cut by shard, and the shards that have any (of many shards most have nothing of a block)."""
    at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    return at, np.flatnonzero(np.diff(at))


def pack_runs(values: np.ndarray) -> bytes:
    """Numbers of which many in a row are equal: each with how often it comes."""
    fresh = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    lengths = pack_counts(np.diff(np.append(fresh, len(values))))
    return len(lengths).to_bytes(8, "little") + lengths + pack_counts(values[fresh])


def unpack_runs(blob: bytes) -> np.ndarray:
    n = 8 + int.from_bytes(blob[:8], "little")
    return np.repeat(unpack_counts(blob[n:]), unpack_counts(blob[8:n]))
