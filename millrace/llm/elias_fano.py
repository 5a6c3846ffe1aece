"""Elias-Fano sequences and a two-level n-gram trie over them, in one compact run of bytes that can be memory-mapped.

Nothing is unpacked: a value is found in the mapped bits by selecting its one among the unary high parts. For that a
sequence has a directory, the number of ones before every 64 bits (half a bit a bit), which is mapped too.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

#: Successors of a context, and words asked of it, from which on its stretch is read.
LONG = 64
_BYTE = np.arange(256)[:, None] >> np.arange(8) & 1
_ONES = _BYTE.sum(axis=1).astype(np.uint8)
#: The place of the r-th one of every byte.
_PLACE = np.argsort(1 - _BYTE, axis=1, kind="stable").astype(np.uint8)


def _pack_low(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of every value, one after the other."""
    if not width:
        return b""
    out, step = [], 8 * max(1, (1 << 20) // (8 * width))
    for at in range(0, len(values), step):
        raw = np.ascontiguousarray(values[at : at + step].astype("<u8")).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th one in each 64-bit word."""
    each = word.astype("<u8").view(np.uint8).reshape(-1, 8)
    until = np.cumsum(_ONES[each], axis=1, dtype=np.int64)
    byte = (until <= r[:, None]).sum(axis=1)
    at = np.arange(len(r))
    before = np.where(byte > 0, until[at, byte - 1], 0)
    return 8 * byte + _PLACE[each[at, byte], r - before]


class EliasFano:
    """A non-decreasing sequence of integers below 2**63: high parts in unary, low parts in equal widths."""

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        width = min(56, max(0, (universe // n).bit_length() - 1)) if n else 0
        v = values.astype(np.uint64)
        high = (v >> np.uint64(width)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype("<u4")
        low = _pack_low(v, width)
        low += bytes(8 + -len(low) % 8)
        return struct.pack("<QQQQ", n, width, len(low), len(words)) + low + words.tobytes() + ones.tobytes() + bytes(4 * (len(ones) % 2))

    def __init__(self, data: np.ndarray, at: int = 0):
        self.n, self.width, low, words = struct.unpack("<QQQQ", data[at : at + 32].tobytes())
        begin = at + 32
        self.lanes = np.ndarray(low - 7, "<u8", data[begin : begin + low], 0, (1,))
        self.words = data[begin + low : begin + low + 8 * words].view("<u8")
        ones = begin + low + 8 * words
        self.ones = data[ones : ones + 4 * (words + 1)].view("<u4")
        self.zeros = (np.arange(words + 1) * 64 - self.ones).astype(np.uint32)  # a hundredth of a mapped sequence or so
        self.end = ones + 4 * (words + 1) + 4 * ((words + 1) % 2)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = self._words_of(i)
        return self._value(64 * word + _in_word(self.words[word], i - self.ones[word]) - i, i)

    def _value(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = high.astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = i * self.width
            out |= (self.lanes[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        return out

    def stretch(self, low: int, high: int) -> np.ndarray:
        """The values from place low up to high, read one after the other."""
        first, last = self._words_of(np.array([low, high - 1]))
        bits = np.unpackbits(self.words[first : last + 1].view(np.uint8), bitorder="little")
        i = np.arange(low, high)
        ones = np.flatnonzero(bits)[low - int(self.ones[first]) : high - int(self.ones[first])]
        return self._value(64 * first + ones - i, i)

    def _words_of(self, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ones, i, side="right") - 1

    def _smaller(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below h (over 0): the place of the zero that ends h - 1, without the zeros."""
        out = np.full(len(h), self.n, np.int64)
        inside = np.flatnonzero(h <= int(self.zeros[-1]))
        z = h[inside] - 1
        word = np.searchsorted(self.zeros, z, side="right") - 1
        out[inside] = 64 * word + _in_word(~self.words[word], z - self.zeros[word]) - z
        return np.minimum(out, self.n)

    def successor(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The place of the first value, of those from place low up to high, that is not below x (high if there is none).

        Values that share x's high part are halved, not read one by one.
        """
        x = x.astype(np.uint64)
        h = np.minimum(x >> np.uint64(self.width), np.uint64(1 << 62)).astype(np.int64)
        first = np.zeros(len(x), np.int64)
        some = np.flatnonzero(h > 0)
        first[some] = self._smaller(h[some])
        last = self._smaller(h + 1)
        if low is not None:
            first, last = np.clip(first, low, high), np.clip(last, low, high)
        on = np.flatnonzero(first < last)
        while len(on):
            mid = (first[on] + last[on]) >> 1
            less = self[mid] < x[on]
            first[on[less]] = mid[less] + 1
            last[on[~less]] = mid[~less]
            on = on[first[on] < last[on]]
        return first

    def find(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The place of x from low up to high, -1 where it is not there."""
        i = self.successor(x, low, high)
        inside = np.flatnonzero(i < (self.n if high is None else high))
        out = np.full(len(x), -1, np.int64)
        hit = inside[self[i[inside]] == x[inside].astype(np.uint64)]
        out[hit] = i[hit]
        return out


def mapped(blob: bytes) -> np.ndarray:
    """The bytes in a memory map of the task's own, without a file or folder; it goes with its last reader."""
    if not blob:
        return np.zeros(0, np.uint8)
    pages = mmap.mmap(-1, len(blob))
    pages.write(blob)
    return np.frombuffer(pages, np.uint8)


class Trie:
    """Contexts, monotone pointers to their successors, successors relative to their context, and a code for each.

    Level 1 has the contexts in order. The successors of the context of rank k lie between pointers k and k + 1 of level
    2, as (k, word), so that the whole level does not decrease; a search looks between the two pointers only. Where
    many words are asked of a context with many successors, these are read once, one after the other.
    """

    @staticmethod
    def encode(context: np.ndarray, word: np.ndarray, code: np.ndarray, bits: int) -> bytes:
        """Of pairs sorted by context, then word, both of ``bits`` bits; code: one byte each."""
        fresh = np.ones(len(context), bool)
        fresh[1:] = context[1:] != context[:-1]
        rank = np.cumsum(fresh) - 1
        contexts = context[fresh]
        pointers = np.append(np.flatnonzero(fresh), len(context))
        below = int(contexts[0]) if len(contexts) else 0
        levels = [
            EliasFano.encode(contexts - np.uint64(below), (int(contexts[-1]) - below + 1) if len(contexts) else 1),
            EliasFano.encode(pointers, len(context) + 1),
            EliasFano.encode((rank.astype(np.uint64) << np.uint64(bits)) | word, max(1, len(contexts)) << bits),
        ]
        return struct.pack("<QQ", bits, below) + b"".join(levels) + code.astype(np.uint8).tobytes()

    def __init__(self, data: np.ndarray):
        bits, below = struct.unpack("<QQ", data[:16].tobytes())
        self.bits, self.below = np.uint64(bits), np.uint64(below)
        self.contexts = EliasFano(data, 16)
        self.pointers = EliasFano(data, self.contexts.end)
        self.words = EliasFano(data, self.pointers.end)
        self.codes = data[self.words.end :]

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of every pair (0: not there); pairs with one context should follow each other."""
        out = np.zeros(len(context), np.uint8)
        if not len(context):
            return out
        fresh = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        asked = context[fresh]
        inside = np.flatnonzero(asked >= self.below)
        rank = np.full(len(asked), -1, np.int64)
        rank[inside] = self.contexts.find(asked[inside] - self.below)
        known = np.flatnonzero(rank >= 0)
        begin, end = np.zeros((2, len(asked)), np.int64)
        begin[known] = self.pointers[rank[known]].astype(np.int64)
        end[known] = self.pointers[rank[known] + 1].astype(np.int64)
        asks = np.diff(np.append(fresh, len(context)))
        for k in np.flatnonzero((end - begin > LONG) & (asks > LONG)).tolist():  # much asked of one context
            values = self.words.stretch(int(begin[k]), int(end[k]))
            x = np.uint64(rank[k]) << self.bits | word[fresh[k] : fresh[k] + asks[k]]
            place = np.minimum(np.searchsorted(values, x), len(values) - 1)
            hit = np.flatnonzero(values[place] == x)
            out[fresh[k] + hit] = self.codes[begin[k] + place[hit]]
            rank[k] = -1
        of = np.repeat(np.arange(len(asked)), asks)
        at = np.flatnonzero(rank[of] >= 0)
        of = of[at]
        place = self.words.find(rank[of].astype(np.uint64) << self.bits | word[at], begin[of], end[of])
        hit = place >= 0
        out[at[hit]] = self.codes[place[hit]]
        return out
