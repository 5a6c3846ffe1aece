"""Word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from millrace.llm._text import lower_ascii, ragged, utf8, words
from millrace.llm.xxh import xxh64

SEED = 42


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, lengths of all shingles (words with one space between), and the number of the text each is in.

    A text of fewer words than ``size`` has one shingle of them all, a text without words none.
    """
    raw, offsets = utf8(texts)
    raw = lower_ascii(raw)
    start, end, owner = words(raw, offsets)
    wide = end - start + 1
    at = np.cumsum(wide) - wide
    line = np.full(int(wide.sum()), 0x20, np.uint8)
    line[ragged(wide - 1, at)] = raw[ragged(wide - 1, start)]
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(texts)), number)
    a = ragged(number, first)
    b = np.minimum(a + size, (first + count)[text]) - 1
    return line, at[a], at[b] + wide[b] - 1 - at[a], text


def hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, and the number of the text each is in."""
    line, start, length, text = shingles(texts, size)
    return (xxh64(line, start, length, SEED) if len(start) else np.zeros(0, np.uint64)), text
