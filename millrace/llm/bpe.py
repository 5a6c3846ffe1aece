"""Byte-pair encoding by forced-boundary splitting, over whole arrays of texts.

A pair of bytes that stands side by side in no vocabulary entry can never be joined by a merge, so the place between
them is a certain cut: fragments on either side are encoded on their own and their ids put one after the other.
Texts are cut into words as the vocabulary's pre-tokeniser does, words into fragments at certain cuts; each distinct
fragment is merged once, all fragments of a chunk side by side, and ids are gathered back by position. Fragments are
the same only if their bytes are.

All of Unicode goes this way. Of every code point that a worker meets for the first time, the tokenizers library is
asked once for its class (letter, number, white space or other) and lower case; what it takes for one word or two
says which. Where a vocabulary wants canonical composition, texts with characters that may compose are composed by
unicodedata, and texts with characters that it and the library see differently by the library's normaliser. The text of a
special token stands for its id; what is between is encoded as texts of their own. Two forms of vocabulary file are
known, byte-level words with their space and lower-cased words with an end mark; others are refused. Null and empty
texts have no ids.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

from millrace.llm._text import code_points, distinct, ragged

#: Distinct fragments whose ids a worker keeps for later chunks; after that many it starts anew.
KEPT = 300_000
_NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
#: What a text needs before its characters are looked at.
_COMPOSE, _EXPAND, _STRANGE = 1, 2, 4
# The normaliser and pre-tokeniser of the two forms of vocabulary files.
WORDS_WITH_SPACE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORDS_WITH_END = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


_second: list[set[str]] = []


def _may_compose(ch: str) -> bool:
    """Whether canonical composition may change a text because of this character."""
    if not _second:
        halves = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
        _second.append({chr(int(x[1], 16)) for x in halves if len(x) == 2 and not x[0].startswith("<")})
    jamo = 0x1161 <= ord(ch) <= 0x1175 or 0x11A8 <= ord(ch) <= 0x11C2
    return jamo or ch in _second[0] or unicodedata.combining(ch) != 0 or unicodedata.normalize("NFC", ch) != ch


class BytePairEncoder:
    """Encodes and decodes as ``tokenizers.Tokenizer.from_file(path)`` does without adding special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self._library = path, None
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: With a suffix white space is dropped, text is lower-cased and numbers are cut into digits.
        self.spaced = not self.suffix
        form = (spec["normalizer"], spec["pre_tokenizer"], model["type"])
        if form != ((None, WORDS_WITH_SPACE, "BPE") if self.spaced else (LOWERED, WORDS_WITH_END, "BPE")):
            raise ValueError(f"{path} is not of a known form: {form}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that depend on what is around them")
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.cut_specials = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.cls = np.full(0x110000, _UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.needs = np.zeros(0x110000, np.uint8)
        self.grown: dict[str, str] = {}  # characters whose lower case is longer
        letters = _byte_letters()
        self.first = np.array([self.vocab[x] for x in letters], np.int32)
        self.final = np.array([self.vocab[x + self.suffix] for x in letters], np.int32)
        byte_of = self.byte_of = {x: b for b, x in enumerate(letters)}
        self.inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            if all(x in byte_of for x in body):
                for a, b in zip(body, body[1:]):
                    self.inside[byte_of[a], byte_of[b]] = True
        self._merges(model["merges"])
        self.strings = [""] * (1 + max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in [*self.vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.strings[i] = token
        self._forget()

    def _merges(self, merges: list) -> None:
        """An open-addressed table from (left id, right id) to the merge's rank."""
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        self.made = np.zeros(len(merges), np.int32)
        keys = self.keys.tolist()
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.made[rank] = self.vocab[a + b]
            key = self.vocab[a] << 17 | self.vocab[b]
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
            while keys[at] != -1:
                at = at + 1 & (1 << self.bits) - 1
            keys[at] = key
            self.ranks[at] = rank
        self.keys = np.array(keys, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 17 | right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], _NONE)
        left_over = np.flatnonzero((found != key) & (found != -1))
        while len(left_over):
            at[left_over] = at[left_over] + 1 & (1 << self.bits) - 1
            found = self.keys[at[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        return out

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Applies all merges to fragments that lie end to end; their ids likewise, and how many each has."""
        counts = np.zeros(len(lengths), np.int64)
        done_words, done_ids = [], []
        number = np.arange(len(lengths))
        rank = None
        while len(lengths):
            starts = np.cumsum(lengths) - lengths
            if rank is None:
                rank = np.full(len(symbols), _NONE, np.int32)
                rank[:-1] = self._rank(symbols[:-1], symbols[1:])
                rank[starts[1:] - 1] = _NONE
            best = np.minimum.reduceat(rank, starts)
            stay = best != _NONE
            if not stay.all():
                each = np.repeat(stay, lengths)
                done_words.append(number[~stay])
                done_ids.append(symbols[~each])
                counts[number[~stay]] = lengths[~stay]
                symbols, rank, number, lengths, best = symbols[each], rank[each], number[stay], lengths[stay], best[stay]
                if not len(lengths):
                    break
                starts = np.cumsum(lengths) - lengths
            hit = rank == np.repeat(best, lengths)
            twice = np.flatnonzero(hit[1:] & hit[:-1])
            if len(twice):  # as in "aaa": of hits in a row, every other one counts
                at = np.flatnonzero(hit)
                fresh = np.ones(len(at), bool)
                fresh[1:] = np.diff(at) > 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - run) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            word = np.searchsorted(starts, at, side="right") - 1
            lengths = lengths - np.bincount(word, minlength=len(lengths))
            at = at - np.arange(len(at))  # where they are without the symbols that go
            symbols, rank = symbols[keep], rank[keep]
            last = np.zeros(len(symbols), bool)
            ends = np.cumsum(lengths)
            last[ends - 1] = True
            near = np.zeros(len(symbols), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            now = np.flatnonzero(near)
            inner = now[~last[now]]
            rank[now] = _NONE
            rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        flat = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        size = counts[words]
        begin = np.empty(len(counts), np.int64)
        begin[words] = np.cumsum(size) - size
        return flat[ragged(counts, begin)], counts

    def _pieces(self, c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        n, k = len(c), self.cls[c]
        doc = np.zeros(n + 1, bool)
        doc[offsets] = True
        cut = np.ones(n + 1, bool)
        cut[1:n] = k[1:] != k[:-1]
        cut |= doc
        runs = np.flatnonzero(cut)
        if not self.spaced:
            cut[:n] |= k == _NUMBER
        quote = np.flatnonzero((c == 0x27) & cut[:n])
        for q in quote.tolist():
            if self.spaced and q and not doc[q] and c[q - 1] == 0x20:
                continue
            if q + 1 >= n or doc[q + 1]:
                continue
            one = chr(c[q + 1])
            two = one + chr(c[q + 2]) if q + 2 < n and not doc[q + 2] else ""
            if width := 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0:
                cut[q + 1 : q + width] = False
                cut[q + width] = True
        if self.spaced:
            s, e = runs[:-1], runs[1:]
            blank = k[s] == _SPACE
            s, e = s[blank], e[blank]
            inner = ~doc[e]
            s, e = s[inner], e[inner]
            cut[e - 1] = True
            cut[e[c[e - 1] == 0x20]] = False
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        if not self.spaced:
            real = k[starts] != _SPACE
            starts, ends = starts[real], ends[real]
        return starts, ends

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _learn(self, c: np.ndarray) -> None:
        """Asks the library about code points that were not met before."""
        new = np.flatnonzero(np.bincount(c[self.cls[c] == _UNKNOWN], minlength=1)).tolist()
        if not new:
            return
        words = lambda x: len(self.library().pre_tokenizer.pre_tokenize_str(x))
        for i in new:
            ch = chr(i)
            if words(f"a{ch}a") == 1:
                self.cls[i] = _LETTER
            elif words(f"!{ch}!") == 1:
                self.cls[i] = _OTHER
            else:
                self.cls[i] = _NUMBER if words(f"1{ch}1") == (1 if self.spaced else 3) else _SPACE
            if self.spaced:
                continue
            if unicodedata.category(ch) == "Cn":
                self.needs[i] = _STRANGE
            elif _may_compose(ch):
                tried = [f"a{ch}", f"a\u0345{ch}", f"a{ch}\u0334"]  # marks of the highest and the lowest class beside it
                known = all(self.library().normalizer.normalize_str(x) == unicodedata.normalize("NFC", x).lower() for x in tried)
                self.needs[i] = _COMPOSE if known else _STRANGE
            else:
                low = self.library().normalizer.normalize_str(ch)
                if self.cls[i] != _SPACE and len(low) == 1:
                    self.lower[i] = ord(low)
                elif self.cls[i] != _SPACE:
                    self.needs[i], self.grown[ch] = _EXPAND, low

    def _prepared(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points as the pre-tokeniser sees them (but for kinds of white space), and where each text starts."""
        c, offsets = code_points(texts)
        self._learn(c)
        if self.spaced:
            return c, offsets
        at = np.flatnonzero(self.needs[c])
        if len(at):
            wants = np.zeros(len(texts), np.uint8)
            np.bitwise_or.at(wants, np.searchsorted(offsets, at, side="right") - 1, self.needs[c[at]])
            texts = list(texts)
            for i in np.flatnonzero(wants).tolist():
                if wants[i] & _STRANGE:
                    texts[i] = self.library().normalizer.normalize_str(texts[i])
                    continue
                if wants[i] & _COMPOSE:
                    texts[i] = unicodedata.normalize("NFC", texts[i])
                    self._learn(code_points([texts[i]])[0])
                for ch, low in self.grown.items():
                    texts[i] = texts[i].replace(ch, low)
            c, offsets = code_points(texts)
            self._learn(c)
        c = self.lower[c]
        self._learn(c)
        return c, offsets

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (int32), and where each text's start (one more entry: the end)."""
        hold = {i for i, t in enumerate(texts) if any(x in t for x in self.specials)}
        if not hold:
            return self._encode(texts)
        parts: list[str] = []
        plan: list[list[int]] = []  # of each text: places of its parts, or -1 - id
        for i, t in enumerate(texts):
            if i not in hold:
                plan.append([len(parts)])
                parts.append(t)
                continue
            steps, begin = [], 0
            for m in self.cut_specials.finditer(t):
                steps += [len(parts), -1 - self.specials[m.group()]]
                parts.append(t[begin : m.start()])
                begin = m.end()
            plan.append([*steps, len(parts)])
            parts.append(t[begin:])
        ids, at = self._encode(parts)
        bounds = at.tolist()
        pieces, size = [], np.zeros(len(texts) + 1, np.int64)
        for i, steps in enumerate(plan):
            for k in steps:
                pieces.append(ids[bounds[k] : bounds[k + 1]] if k >= 0 else np.array([-1 - k], np.int32))
                size[i + 1] += len(pieces[-1])
        return np.concatenate(pieces), np.cumsum(size)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        c, offsets = self._prepared(texts)
        if not len(c):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts, ends = self._pieces(c, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        where = np.zeros(len(c) + 1, np.int64)
        np.cumsum(1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000), out=where[1:])
        b = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        # certain cuts inside words
        mark = np.zeros(len(b) + 1, np.uint8)
        mark[np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1] = 1
        mark[where[starts]] = 2
        if not self.spaced:
            stop = where[ends]
            mark[stop[mark[stop] != 2]] = 3  # white space follows
            blank = np.flatnonzero(self.cls[c] == _SPACE)
            for k in range(3):
                at = where[blank] + k
                mark[at[at < where[blank + 1]]] = 3
        mark[len(b)] = 3
        edges = np.flatnonzero(mark)
        begin, stop = edges[:-1], edges[1:]
        real = mark[begin] != 3
        begin, stop = begin[real], stop[real]
        number, first = distinct(b, begin, stop)
        if self.suffix:  # the same bytes inside a word and at its end are two fragments
            final = mark[stop] != 1
            number = 2 * number + final
            first_of = np.full(2 * len(first), -1, np.int64)
            first_of[number[::-1]] = np.arange(len(number))[::-1]
            used = np.flatnonzero(first_of >= 0)
            place_of = np.zeros(len(first_of), np.int64)
            place_of[used] = np.arange(len(used))
            number, first = place_of[number], first_of[used]
        else:
            final = np.zeros(len(begin), bool)
        chosen = self._places(b, begin[first], stop[first], final[first])[number]
        counts = self.count[chosen]
        ids = self.ids[ragged(counts, self.begin[chosen])]
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        return ids, total[np.searchsorted(begin, where[offsets], side="left")]

    def _places(self, b: np.ndarray, begin: np.ndarray, stop: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Where the ids of distinct fragments are kept; unknown ones are merged first. They are known by their bytes."""
        if len(self.place) > KEPT:
            self._forget()
        raw = b.tobytes()
        ends = (b"\0", b"\1")
        names = [raw[i:j] + ends[e] for i, j, e in zip(begin.tolist(), stop.tolist(), final.tolist())] if self.suffix else [raw[i:j] for i, j in zip(begin.tolist(), stop.tolist())]
        at = np.array([self.place.get(x, -1) for x in names], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            lengths = (stop - begin)[new]
            units = b[ragged(lengths, begin[new])]
            symbols = self.first[units]
            if self.suffix:
                last = np.cumsum(lengths)[final[new]] - 1
                symbols[last] = self.final[units[last]]
            ids, counts = self.merge(symbols, lengths)
            base = len(self.place)
            while base + len(new) > len(self.begin):
                self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.begin[base : base + len(new)] = self.used + np.cumsum(counts) - counts
            self.count[base : base + len(new)] = counts
            self.used += len(ids)
            at[new] = np.arange(base, base + len(new))
            self.place.update(zip([names[i] for i in new.tolist()], range(base, base + len(new))))
        return at

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False): entries with a space between, or bytes for a byte-level decoder."""
        entries = map(self.strings.__getitem__, ids)
        if not self.byte_level_decoder:
            return " ".join(entries)
        known = self.byte_of
        return b"".join(bytes(known[x] for x in e) if all(x in known for x in e) else e.encode() for e in entries).decode("utf-8", "replace")


_made: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _made:
        _made[path] = BytePairEncoder(path)
    return _made[path]
