"""XXH64 of many spans of one byte array at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Longer spans are hashed one by one.
_VECTOR = 256
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of data[start : start + length] for every span (uint8 data)."""
    long = np.flatnonzero(length > _VECTOR)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out = np.empty(len(start), np.uint64)
        rest = np.flatnonzero(length <= _VECTOR)
        out[rest] = xxh64(data, start[rest], length[rest], seed)
        out[long] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(start[long].tolist(), length[long].tolist())]
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes8 = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    lanes4 = np.ndarray(len(padded) - 7, "<u4", padded, 0, (1,))
    seed64 = np.uint64(seed)
    at, left = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed64 + _P5, np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), v, np.uint64) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            pos, stripes = at[long].copy(), left[long] // 32
            on = np.arange(len(long))
            done = 0
            while len(on):
                for j in range(4):
                    acc[j][on] = _round(acc[j][on], lanes8[pos[on] + 8 * j])
                pos[on] += 32
                done += 1
                on = on[stripes[on] > done]
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for v in acc:
                x = (x ^ _round(np.uint64(0), v)) * _P1 + _P4
            h[long] = x
            at, left = at.copy(), left.copy()
            at[long], left[long] = pos, left[long] % 32
        h += length.astype(np.uint64)
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ _round(np.uint64(0), lanes8[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        h[on] = _rotl(h[on] ^ (lanes4[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left >= 1)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ (padded[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            left[on] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h
