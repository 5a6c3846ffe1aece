"""Quality rules: word and line counts, then tokeniser fertility with bands by language or script.

Public vocabularies encode the whole text. Characters per token fall where text is unlike prose (codes, symbols between
words), the share of byte tokens rises with characters foreign to a vocabulary, and the entropy of a text's tokens
falls when it repeats itself. Each vocabulary has a band of these three by language, or by most frequent script where
it has none for the language. A text is rejected if it leaves its band in every vocabulary: a text that only one of
them finds odd stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._spark import id_type
from millrace.llm._text import chunks, code_points, distinct, utf8, words
from millrace.llm.bpe import encoder

WINDOW_WORDS = 3
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50


class Band(NamedTuple):
    least_chars: float  # per token
    most_chars: float
    most_bytes: float  # share of byte-fallback tokens
    least_entropy: float  # bits, of the text's tokens


#: By vocabulary file and language, of documents labelled good that pass the base rules (sf0.1, not held out: 2,432): the
#: 2 % quantile of characters a token, 1.02 times the 99.9 % quantile, 1.5 times the 99.7 % quantile of byte tokens, and
#: 0.1 below the 0.3 % quantile of entropy.
LANGUAGE_BANDS = {
    "piece_bpe_32k.model": {"en": Band(2.508, 2.885, 0.044, 5.67), "de": Band(2.513, 2.825, 0.033, 5.71), "fr": Band(2.242, 2.581, 0.048, 5.61), "es": Band(2.194, 2.531, 0.035, 5.72)},
    "byte_bpe_50k.json": {"en": Band(2.55, 2.95, 0.005, 5.68), "de": Band(2.29, 2.578, 0.057, 5.84), "fr": Band(2.118, 2.446, 0.111, 5.64), "es": Band(2.0, 2.402, 0.107, 5.61)},
}
#: Not measured: the tables have no texts of other languages.
SCRIPT_BANDS = {
    "latin": Band(1.5, 7.0, 0.2, 4.5),
    "greek": Band(0.8, 6.0, 0.3, 4.0),
    "cyrillic": Band(1.0, 7.0, 0.2, 4.5),
    "east asian": Band(0.3, 2.5, 0.95, 4.0),
    "other": Band(0.3, 7.0, 0.95, 3.5),
}
#: First code point of each stretch, and the place of its script in SCRIPT_BANDS (-1: none).
_STRETCHES = ((0, -1), (0x41, 0), (0x5B, -1), (0x61, 0), (0x7B, -1), (0xC0, 0), (0x250, 4), (0x370, 1), (0x400, 2), (0x530, 4), (0x1E00, 0), (0x1F00, 1), (0x2000, -1), (0x2E80, 3), (0xA4D0, 4), (0xAC00, 3), (0xD7A4, 4), (0xE000, -1), (0xF900, 3), (0xFB00, 4), (0xFE00, -1), (0x20000, 3), (0x30000, 4))


def text_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    n = len(texts)
    raw, offsets = utf8(texts)
    start, end, owner = words(raw, offsets)
    count = np.bincount(owner, minlength=n)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])  # code points
    symbol = np.flatnonzero(np.isin(raw, [ord(x) for x in SYMBOLS]))
    # words in windows found twice or more in their text; words and windows are numbered, so that equal means equal
    number = distinct(raw, start, end)[0] if len(start) else start
    m = max(len(number) - WINDOW_WORDS + 1, 0)
    window = number[:m]
    for k in range(1, WINDOW_WORDS):
        window = np.unique(window * (1 + int(number.max(initial=0))) + number[k : m + k], return_inverse=True)[1]
    inside = np.flatnonzero(owner[:m] == owner[WINDOW_WORDS - 1 :]) if m else np.zeros(0, np.int64)
    _, back, often = np.unique(window[inside] * n + owner[inside], return_inverse=True, return_counts=True)
    again = inside[often[back] > 1]
    repeated = np.zeros(len(number), bool)
    for k in range(WINDOW_WORDS):
        repeated[again + k] = True
    # lines with a word that are equal to an earlier one
    feed = np.flatnonzero(raw == 0x0A)
    line_start = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    line_start = line_start[line_start < len(raw)]
    line_end = np.append(line_start[1:], len(raw)) if len(line_start) else line_start
    after = np.zeros(len(raw) + 1, bool)
    after[feed + 1] = True
    line_of = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = line_end - after[line_end] if len(line_start) else line_end
    first_word = np.searchsorted(start, line_start)
    has_word = first_word < len(start)
    has_word[has_word] = start[first_word[has_word]] < line_end[has_word]
    owners = line_of[has_word]
    lines = distinct(raw, line_start[has_word], line_end[has_word])[0] if len(owners) else owners
    _, first_line = np.unique(lines * n + owners, return_index=True)
    duplicates = np.bincount(owners, minlength=n) - np.bincount(owners[first_line], minlength=n)
    return {
        "n_words": count,
        "word_chars": np.bincount(owner, weights=before[end] - before[start], minlength=n).astype(np.int64),
        "n_symbols": np.bincount(np.searchsorted(offsets, symbol, side="right") - 1, minlength=n),
        "n_dup_lines": duplicates,
        "n_repeat_words": np.bincount(owner[repeated], minlength=n),
    }


def scripts(texts: list[str]) -> np.ndarray:
    """The place in SCRIPT_BANDS of every text's most frequent script ("other" without letters)."""
    c, offsets = code_points(texts)
    kind = np.array([s for _, s in _STRETCHES])[np.searchsorted([a for a, _ in _STRETCHES], c, side="right") - 1]
    at = np.flatnonzero(kind >= 0)
    owner = np.searchsorted(offsets, at, side="right") - 1
    table = np.bincount(owner * len(SCRIPT_BANDS) + kind[at], minlength=len(texts) * len(SCRIPT_BANDS)).reshape(-1, len(SCRIPT_BANDS))
    return np.where(table.any(axis=1), table.argmax(axis=1), len(SCRIPT_BANDS) - 1)


class Fertility:
    """A sentencepiece (``.model``) or byte-level (``.json``) vocabulary and what its tokens say about a text.

    Byte tokens are sentencepiece's byte fallbacks, or entries of one byte that is a part of a character.
    """

    def __init__(self, path: str):
        self.name = path.rpartition("/")[2]
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            self.encode = lambda texts: self._flat(model.encode(texts, num_threads=1))
        else:
            bpe = encoder(path)
            self.is_byte = np.zeros(len(bpe.strings), bool)
            self.is_byte[bpe.first[0x80:]] = True
            self.encode = bpe.encode

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(lists), np.int64, int(at[-1])), at

    def measure(self, texts: list[str]) -> dict[str, np.ndarray]:
        """n_tokens, chars_per_token, byte_share, token_entropy (all 0 for a text without tokens)."""
        ids, at = self.encode(texts)
        size = np.diff(at)
        owner = np.repeat(np.arange(len(texts)), size)
        pairs, times = np.unique(owner << 20 | ids, return_counts=True)
        some = np.maximum(size, 1)
        share = times / some[pairs >> 20]
        return {
            "n_tokens": size,
            "chars_per_token": np.array([len(t) for t in texts]) / some * (size > 0),
            "byte_share": np.bincount(owner, weights=self.is_byte[ids], minlength=len(texts)) / some,
            "token_entropy": np.maximum(-np.bincount(pairs >> 20, weights=share * np.log2(share), minlength=len(texts)), 0),
        }


_fertility: dict[str, Fertility] = {}

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
_MEASURES = ", n_tokens{0} long, chars_per_token{0} double, byte_share{0} double, token_entropy{0} double"


def apply_rules(docs: DataFrame, vocabularies: list[str], languages: dict[str, dict[str, Band]] = LANGUAGE_BANDS, by_script: dict[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the token measures of every row of docs (doc_id of any type, text, lang).

    Measures of the second vocabulary have a _2 after their names, and so on. A null text counts as one without words;
    it fails, as every text of under 50 words does. A null or unknown lang is judged by script; of scripts with equally
    many letters the first in SCRIPT_BANDS counts. Very long texts are read whole. Repeated rows come out as often as
    they go in; other columns are not read; an empty table gives no rows; nothing is shuffled.
    """
    ordered = list(by_script.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in vocabularies:
            if path not in _fertility:
                _fertility[path] = Fertility(path)
        for rows, texts in chunks(batches):
            counts, langs = text_counts(texts), rows.column("lang").to_pylist()
            strange = [i for i, x in enumerate(langs) if any(x not in languages.get(_fertility[path].name, {}) for path in vocabularies)]
            script = dict(zip(strange, scripts([texts[i] for i in strange]).tolist()))
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            fits, measures = np.zeros(len(texts), bool), {}
            for k, path in enumerate(vocabularies):
                own = languages.get(_fertility[path].name, {})
                m = _fertility[path].measure(texts)
                band = np.array([own[x] if x in own else ordered[script[i]] for i, x in enumerate(langs)])
                fits |= (m["chars_per_token"] >= band[:, 0]) & (m["chars_per_token"] <= band[:, 1]) & (m["byte_share"] <= band[:, 2]) & (m["token_entropy"] >= band[:, 3])
                measures |= {name + (f"_{k + 1}" if k else ""): v for name, v in m.items()}
            yield from pa.table({"doc_id": rows.column("doc_id"), **counts, "base_failed": failed, "kept": ~failed & fits, **measures}).to_batches()

    fields = _COUNTS + "".join(_MEASURES.format(f"_{k + 1}" if k else "") for k in range(len(vocabularies)))
    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {id_type(docs)}, {fields}")
