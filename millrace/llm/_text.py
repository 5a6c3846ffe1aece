"""Vectorised text scanning shared by the operators: whole texts of a chunk are laid end to end in one array."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.xxh import xxh64

#: Characters that are worked on at once. A longer text makes a chunk of its own: texts are never cut.
CHUNK_CHARS = 800_000

try:  # only glibc has it
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):
    _libc = None

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64) + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_UNIT = mix64(np.arange(1 << 16))
_powers: dict[int, np.ndarray] = {}
#: Longest span of a GramHash.
LONGEST_GRAM = 64


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * (len(have) if have is not None else 0), 1 << 16), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step)
    return have[:n]


class GramHash:
    """Rolling polynomial hashes (modulo 2**64) of short spans of one array of code points, after one pass over it.

    Only for spans of at most LONGEST_GRAM units: of structured texts of about 1,024 letters and more a polynomial
    modulo a power of two is the same whatever its base. ``span_hash`` has no such bound.
    """

    def __init__(self, units: np.ndarray):
        values = _UNIT[units] if not len(units) or int(units.max()) < 1 << 16 else mix64(units)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(values * _power(_BASE, len(units)), out=self.sums[1:])
        self.back = _power(_BASE_INV, len(units) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(start) and int((end - start).max()) > LONGEST_GRAM:
            raise ValueError(f"a gram has at most {LONGEST_GRAM} units")
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


_LONG = np.uint64(1 << 63)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of an array of bytes on, as one number each; zeros follow its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: of up to 7 bytes a scrambling of the bytes themselves, of others their XXH64."""
    key, long = _keys(data, lanes(data), start, end - start)
    out = mix64(key)
    out[long] = key[long]
    return out


def _keys(data: np.ndarray, eight: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans of up to 7 bytes, the bytes with their length on top; of others, XXH64. And which ones are long."""
    short = np.minimum(length, 7).astype(np.uint64)
    key = eight[start] & (np.uint64(1) << (short << np.uint64(3))) - np.uint64(1) | short << np.uint64(56)
    long = np.flatnonzero(length > 7)
    if len(long):
        key[long] = xxh64(data, start[long], length[long])
    return key, long


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every span among the distinct spans of bytes, and for each distinct one a span that is equal to it.

    Spans are found by number or hash, but are the same only if their bytes are: those that differ from the first span
    of their hash are told apart by a dictionary of bytes.
    """
    length, eight = end - start, lanes(data)
    key, long = _keys(data, eight, start, length)
    key[long] |= _LONG
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    if len(long):
        like = first[number[long]]
        other = long[_differ(eight, start[long], length[long], start[like], length[like])]
        found: dict[bytes, int] = {}
        more = []
        for i in other.tolist():
            body = data[start[i] : end[i]].tobytes()
            if body not in found:
                found[body] = len(first) + len(more)
                more.append(i)
            number[i] = found[body]
        first = np.append(first, more).astype(np.int64)
    return number, first


def _differ(eight: np.ndarray, a: np.ndarray, size: np.ndarray, b: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether spans of over 7 bytes differ; eight bytes are compared at once."""
    out = size != other_size
    same = np.flatnonzero(~out & (a != b))
    if len(same):
        n = -(-size[same] // 8)
        at = np.minimum(8 * ragged(n, np.zeros(len(n), np.int64)), np.repeat(size[same] - 8, n))
        unlike = eight[np.repeat(a[same], n) + at] != eight[np.repeat(b[same], n) + at]
        out[same] = np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    return out


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total, dtype=out.dtype)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, and where each text starts (one more entry: the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes, and where each text starts (one more entry: the end)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def release() -> None:
    """Gives memory that is not in use back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_CHARS) -> Iterator[tuple[pa.Table, list[str]]]:
    """Regroups Arrow batches into tables of about ``size`` characters of ``column``, with its texts (null: empty).

    At the end of a task the memory that its chunks have used is given back: the worker lives on.
    """
    try:
        yield from _chunks(batches, column, size)
    finally:
        release()


def _chunks(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[pa.Table, list[str]]]:
    held: list[pa.RecordBatch] = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        begin = 0
        values = batch.column(column).to_pylist()
        for i, value in enumerate(values):
            text = value or ""
            if texts and chars + len(text) > size:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held), texts
                held, texts, chars, begin = [], [], 0, i
            texts.append(text)
            chars += len(text)
        if len(values) > begin:
            held.append(batch.slice(begin))
    if texts:
        yield pa.Table.from_batches(held), texts


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` in bytes or code points: starts, ends and the number of the text each is in."""
    space = _SPACE[units] if units.dtype == np.uint8 else _SPACE[np.minimum(units, 255)]
    edge = np.ones(len(units) + 1, bool)  # whether a word that is here starts here
    edge[1:] = space
    edge[offsets] = True
    start = np.flatnonzero(~space & edge[:-1])
    stop = np.zeros(len(units) + 1, bool)
    stop[:-1] = space
    stop[offsets] = True
    last = np.flatnonzero(~space & stop[1:])
    return start, last + 1, np.searchsorted(offsets, start, side="right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(units: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; everything else stays."""
    return _LOWER[units]
