"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower-cased. A word's evidence for each language comes from hashed features: its first and
last one to three letters, its character trigrams with the borders, and a lexicon, the share of each language in all
training words that hash as it does. Learned weights of these and learned transitions between neighbouring words make
one chain of a text's words; forward-backward gives each word's distribution over languages, so text that switches
language is labelled word by word. A text's language is the one with the largest share of its letters. Chains are
worked on in blocks of BLOCK_WORDS words side by side; what a block does to the messages that come from before and
behind is a matrix, and these carry the messages over all blocks, so a long text is still one chain. With more than
BLOCK_LANGUAGES languages such matrices would cost more than the chain itself: texts are then gone through word by word,
all texts side by side, forward once and backward once, and only some steps of them are held at a time.

Every language that a training document has is learned. The lexicon counts every word of every training document.
Weights and transitions are fitted on a sample of SAMPLE_DOCS documents a language, of each at most its first
SAMPLE_CHARS characters, in stretches of BLOCK_WORDS words, some of them joined from two languages. A language takes
1 MB of the model, which the driver and every worker hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._spark import id_type
from millrace.llm._sums import keep_rows, summed
from millrace.llm._text import chunks, code_points, mix64, span_hash

BLOCK_WORDS = 64
#: Documents of a language that the weights are fitted on, and the characters that are read of one of them.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 200_000
#: Languages whose words are counted in one pass, and up to which a block is carried over as a matrix.
BLOCK_LANGUAGES = 64
#: Values (words by languages) that one array of a worker or the fit has, about.
HELD_VALUES = 1 << 22
_SLOTS = 1 << 17
_LEXICON = 1 << 16
#: The pipeline rejects texts whose largest share of letters is smaller, and texts whose words are as hardly any
#: training word of that language: their mean evidence is below this part of what the language's own words have.
LEAST_SHARE = 0.35
LEAST_EVIDENCE = 0.25
#: Words that a text is taken to have in its language besides its own: a few odd words reject nothing.
_PRIOR_WORDS = 8

_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case."""
    if not _tables:
        every = range(0x110000)
        alpha = np.fromiter((chr(i).isalpha() for i in every), bool, 0x110000)
        low = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(alpha).tolist():
            if i < 0x2000 and len(x := chr(i).lower()) == 1:
                low[i] = ord(x)
        _tables.extend([alpha, low])
    return _tables[0], _tables[1]


class Words:
    """The words of texts and their features; for the lexicon alone, without affixes and trigrams."""

    def __init__(self, texts: list[str], lexicon_only: bool = False):
        alpha, low = _letters()
        c, offsets = code_points(texts)
        letter = alpha[c]
        edge = np.ones(len(c) + 1, bool)
        edge[1:] = ~letter
        edge[offsets] = True
        self.start = np.flatnonzero(letter & edge[:-1])
        stop = np.zeros(len(c) + 1, bool)
        stop[:-1] = ~letter
        stop[offsets] = True
        self.end = np.flatnonzero(letter & stop[1:]) + 1
        self.owner = np.searchsorted(offsets, self.start, side="right") - 1
        self.size = self.end - self.start
        self.texts = len(texts)
        unit = np.where(letter, low[c], 0).astype(np.uint32)
        h = span_hash(unit.view(np.uint8), 4 * self.start, 4 * self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.word = (h >> np.uint64(48)).astype(np.int64) & _LEXICON - 1
        if lexicon_only:
            return
        affixes = []
        for side, (a, step) in enumerate(((self.start, 1), (self.end - 1, -1))):
            packed = np.zeros(len(self.start), np.uint64)
            for k in range(3):  # three letters of 21 bits; a shorter word has none there
                has = np.flatnonzero(self.size > k)
                packed[has] |= unit[a[has] + step * k].astype(np.uint64) << np.uint64(21 * k)
                affixes.append(mix64(mix64(packed) + np.uint64(2 * k + side)) & np.uint64(_SLOTS - 1))
        self.affixes = np.stack(affixes, axis=1).astype(np.int32) if len(self.start) else np.zeros((0, 6), np.int32)
        # trigrams around every letter; a neighbour that is not of the word counts as 0
        at = np.flatnonzero(letter)
        first = np.zeros(len(c), bool)
        first[self.start] = True
        last = np.zeros(len(c), bool)
        last[self.end - 1] = True
        before = np.where(first[at], 0, unit[at - 1]).astype(np.uint64)
        after = np.where(last[at], 0, unit[np.minimum(at + 1, len(c) - 1)]).astype(np.uint64)
        self.grams = (mix64((before << np.uint64(42)) | (unit[at].astype(np.uint64) << np.uint64(21)) | after) & np.uint64(_SLOTS - 1)).astype(np.int32)
        self.gram_start = np.cumsum(self.size) - self.size

    def gram_places(self, at: np.ndarray) -> np.ndarray:
        """Where the trigrams of these words are, word by word."""
        size = self.size[at]
        return np.repeat(self.gram_start[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    def __len__(self) -> int:
        return len(self.start)

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every word, the number of its block and its place there; a text's blocks follow each other."""
        count = np.bincount(self.owner, minlength=self.texts)
        place = np.arange(len(self)) - np.repeat(np.cumsum(count) - count, count)
        fresh = place % BLOCK_WORDS == 0
        return np.cumsum(fresh) - 1, place % BLOCK_WORDS


class Field:
    """Weights of the random field for languages ``names``."""

    def __init__(self, names: list[str], lexicon: np.ndarray):
        n = len(names)
        self.names = names
        self.lexicon = lexicon.astype(np.float32)  # log shares, (_LEXICON, n)
        self.rate = None  # of all words of a language, those in each slot of the lexicon
        self.usual = None  # the mean evidence of a language's own words
        self.weights = np.zeros((_SLOTS, n), np.float32)
        self.trust = np.float32(0.3)
        self.move = (np.eye(n) * 2).astype(np.float32)

    def evidence(self, w: Words, at: np.ndarray | None = None) -> np.ndarray:
        """Each word's evidence for each language, of all words or of those ``at`` these numbers."""
        word, affixes, size, grams = (w.word, w.affixes, w.size, w.grams) if at is None else (w.word[at], w.affixes[at], w.size[at], w.grams[w.gram_places(at)])
        out = self.trust * self.lexicon[word]
        for k in range(affixes.shape[1]):
            out += self.weights[affixes[:, k]]
        begin = np.cumsum(size) - size
        lot = max(1, 4 * HELD_VALUES // len(self.names))
        for lo in range(0, len(grams), lot):  # a word's trigrams may lie in several lots
            a, b = int(np.searchsorted(begin, lo, side="right")) - 1, int(np.searchsorted(begin, lo + lot))
            out[a:b] += np.add.reduceat(self.weights[grams[lo : lo + lot]], np.maximum(begin[a:b] - lo, 0), axis=0)
        return out

    def marginals(self, evidence: np.ndarray, chain: np.ndarray, place: np.ndarray, count_moves: bool = False, follows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each word's distribution over languages by forward-backward, and the expected number of moves between them
        (zeros unless asked for: only fitting needs them). follows: which chains go on from the one before."""
        n = len(self.names)
        if not len(chain):
            return np.zeros((0, n), np.float32), np.zeros((n, n))
        chains, steps = int(chain[-1]) + 1, int(place.max()) + 1
        size = np.bincount(chain)
        order = np.argsort(-size, kind="stable")  # longest first, so those that go on are always the first ones
        row = np.empty(chains, np.int64)
        row[order] = np.arange(chains)
        going = np.searchsorted(-size[order], -np.arange(steps), side="left")
        e = np.zeros((steps, chains, n), np.float32)
        e[place, row[chain]] = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        move = np.exp(self.move - self.move.max()).astype(np.float32)
        before = behind = np.ones((chains, n), np.float32)
        if follows is not None and follows.any():
            before, behind = (x[order] for x in self._messages(e, going, row, move, follows))
        ahead = np.zeros_like(e)
        ahead[0] = e[0] * before + 1e-30
        ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            m = going[t]
            a = (ahead[t - 1, :m] @ move) * e[t, :m] + 1e-30
            ahead[t, :m] = a / a.sum(axis=1, keepdims=True)
        back = behind.copy()
        moves = np.zeros((n, n))
        post = np.zeros_like(e)
        for t in range(steps - 1, -1, -1):
            m = going[t]
            p = ahead[t, :m] * back[:m]
            post[t, :m] = p / p.sum(axis=1, keepdims=True)
            if t:
                right = e[t, :m] * back[:m]
                if count_moves:
                    left = ahead[t - 1, :m].astype(float)
                    moves += move * ((left / ((left @ move) * right).sum(axis=1, keepdims=True)).T @ right)
                b = right @ move.T + 1e-30
                back[:m] = b / b.max(axis=1, keepdims=True)
        return post[place, row[chain]], moves

    def _messages(self, e: np.ndarray, going: np.ndarray, row: np.ndarray, move: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What comes to each block from the blocks before it, and from those behind it (e's rows are in another order)."""
        steps, chains, n = e.shape
        through = np.zeros((chains, n, n), np.float32)  # from the language of a block's first word to that of its last
        through[:, np.arange(n), np.arange(n)] = e[0]
        for t in range(1, steps):
            m = going[t]
            x = (through[:m].reshape(m * n, n) @ move).reshape(m, n, n) * e[t, :m, None, :] + 1e-30
            through[:m] = x / x.max(axis=(1, 2), keepdims=True)
        through = through[row]
        before, behind = np.ones((2, chains, n), np.float32)
        number = np.arange(chains) - np.maximum.accumulate(np.where(follows, 0, np.arange(chains)))  # of a block in its text
        order = np.argsort(number, kind="stable")
        cut = np.cumsum(np.bincount(number))
        for k in range(1, len(cut)):
            at = order[cut[k - 1] : cut[k]]
            x = np.einsum("ci,cij->cj", before[at - 1], through[at - 1]) @ move + 1e-30
            before[at] = x / x.max(axis=1, keepdims=True)
        for k in range(len(cut) - 1, 0, -1):
            at = order[cut[k - 1] : cut[k]]
            x = np.einsum("cij,cj->ci", through[at], behind[at]) @ move.T + 1e-30
            behind[at - 1] = x / x.max(axis=1, keepdims=True)
        return before, behind

    def posterior(self, w: Words) -> np.ndarray:
        """Each word's distribution over languages; a text is one chain."""
        out = np.zeros((len(w), len(self.names)), np.float32)
        for at, post in self.posteriors(w):
            out[at] = post
        return out

    def posteriors(self, w: Words) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
        """As ``posterior``, of some words after others: which, and their distributions."""
        if len(self.names) > BLOCK_LANGUAGES:
            yield from self._by_steps(w)
            return
        chain, place = w.chains()
        first = np.flatnonzero(place == 0)
        follows = np.zeros(len(first), bool)
        follows[1:] = w.owner[first[1:]] == w.owner[first[:-1]]
        yield slice(None), self.marginals(self.evidence(w), chain, place, follows=follows)[0]

    def _by_steps(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Forward-backward over the words of whole texts side by side. Of the way forward only what reaches each span of
        steps is kept; on the way back a span's part of it is worked out again."""
        if not len(w):
            return
        n = len(self.names)
        count = np.bincount(w.owner, minlength=w.texts)
        row = np.empty(w.texts, np.int64)
        row[np.argsort(-count, kind="stable")] = np.arange(w.texts)  # longest first, so those that go on are always the first ones
        place = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        words = np.lexsort((row[w.owner], place))
        going = np.bincount(place)
        cut = np.append(0, np.cumsum(going))
        spans = [0]
        while spans[-1] < len(going):
            spans.append(max(spans[-1] + 1, int(np.searchsorted(cut, cut[spans[-1]] + HELD_VALUES // n, side="right")) - 1))
        move = np.exp(self.move - self.move.max()).astype(np.float32)

        def forward(a: int, b: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            e = self.evidence(w, words[cut[a] : cut[b]])
            e = np.exp(e - e.max(axis=1, keepdims=True))
            ahead = np.empty_like(e)
            for t in range(a, b):
                lo, m = cut[t] - cut[a], going[t]
                x = (e[lo : lo + m] if before is None else (before[:m] @ move) * e[lo : lo + m]) + 1e-30
                before = ahead[lo : lo + m] = x / x.sum(axis=1, keepdims=True)
            return e, ahead

        reach: list[np.ndarray | None] = [None]
        for a, b in zip(spans[:-2], spans[1:-1]):
            reach.append(forward(a, b, reach[-1])[1][cut[b - 1] - cut[a] :].copy())
        back = np.ones((going[0], n), np.float32)
        for a, b in zip(spans[-2::-1], spans[:0:-1]):
            e, post = forward(a, b, reach.pop())
            for t in range(b - 1, a - 1, -1):
                lo, m = cut[t] - cut[a], going[t]
                p = post[lo : lo + m] * back[:m]
                post[lo : lo + m] = p / p.sum(axis=1, keepdims=True)
                x = (e[lo : lo + m] * back[:m]) @ move.T + 1e-30
                back[:m] = x / x.max(axis=1, keepdims=True)
            yield words[cut[a] : cut[b]], post

    def fit(self, stretches: list[str], truth: np.ndarray, rounds: int = 3, batch: int = 800, rate: float = 0.3) -> None:
        """Adaptive gradient steps on the likelihood of the languages of ``stretches`` of at most BLOCK_WORDS words; every
        other chain is joined from two. Of the words only those of a batch are held."""
        n = len(self.names)
        rng = np.random.default_rng(7)
        seen = np.full((_SLOTS, n), 1e-2, np.float32)
        seen_move, seen_trust = np.full((n, n), 1e-2), 1e-2
        lot = max(1, HELD_VALUES // (BLOCK_WORDS * n))
        for _ in range(rounds):
            order = rng.permutation(len(stretches))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                w = Words([stretches[i] for i in own.tolist()])
                size = np.bincount(w.owner, minlength=len(own))
                begin = np.cumsum(size) - size
                chains = []
                for k in range(len(own)):
                    x = np.arange(begin[k], begin[k] + size[k])
                    if k % 2:
                        x = np.concatenate([x[: (len(x) + 1) // 2], np.arange(begin[k - 1], begin[k - 1] + size[k - 1])[: BLOCK_WORDS // 2]])
                    chains.append(x)
                scale = 1 / len(own)
                grad = np.zeros((n, _SLOTS), np.float32)
                move_slope, trust_slope = np.zeros((n, n)), 0.0
                for first in range(0, len(own), lot):
                    some = chains[first : first + lot]
                    index = np.concatenate(some)
                    number = np.repeat(np.arange(len(some)), [len(x) for x in some])
                    spot = np.concatenate([np.arange(len(x)) for x in some])
                    post, moves = self.marginals(self.evidence(w, index), number, spot, True)
                    label = truth[own[w.owner[index]]]
                    slope = -post
                    slope[np.arange(len(label)), label] += 1
                    each = np.arange(len(index))
                    slots = np.concatenate([w.affixes[index].ravel(), w.grams[w.gram_places(index)]])
                    of = np.concatenate([np.repeat(each, 6), np.repeat(each, w.size[index])])
                    for j, x in enumerate(np.ascontiguousarray(slope.T)):
                        grad[j] += np.bincount(slots, weights=x[of], minlength=_SLOTS)
                    inner = np.flatnonzero(spot[1:] > 0) + 1
                    np.add.at(move_slope, (label[inner - 1], label[inner]), 1)
                    move_slope -= moves
                    trust_slope += float((slope * self.lexicon[w.word[index]]).sum())
                for a in range(0, _SLOTS, 1 << 13):
                    part = slice(a, a + (1 << 13))
                    g = grad[:, part].T * np.float32(scale) - np.float32(1e-5) * self.weights[part]
                    seen[part] += g * g
                    self.weights[part] += np.float32(rate * 0.1) * g / np.sqrt(seen[part])
                g = move_slope * scale
                seen_move += g * g
                self.move = (self.move + rate * g / np.sqrt(seen_move)).astype(np.float32)
                g = trust_slope * scale
                seen_trust += g * g
                self.trust = np.float32(self.trust + rate * 0.1 * g / np.sqrt(seen_trust))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its share of the letters (``und`` and 0 without letters)."""
        names, share, _ = self.judge(texts)
        return names, share

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As ``predict``, and how well each text's words are known in its language: about 1 for its own, 0 or less for
        words of none that was learned. Evidence of a word is the logarithm of how much more often the language has its
        slot of the lexicon than chance would."""
        n = len(self.names)
        lot = max(1, HELD_VALUES // max(16 * n, 1))
        if n > BLOCK_LANGUAGES and len(texts) > lot:  # a step of all texts is held at once
            names, share, known = zip(*(self.judge(texts[at : at + lot]) for at in range(0, len(texts), lot)))
            return [x for part in names for x in part], np.concatenate(share), np.concatenate(known)
        w = Words(texts)
        if not len(w) or not n:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        mass = np.zeros((len(texts), n))
        for at, post in self.posteriors(w):
            owner, size = w.owner[at], w.size[at]
            for j in range(n):
                mass[:, j] += np.bincount(owner, weights=post[:, j] * size, minlength=len(texts))
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        names = [self.names[i] if t > 0 else "und" for i, t in zip(best.tolist(), total.tolist())]
        known = np.ones(len(texts))
        if self.rate is not None:
            count = np.bincount(w.owner, minlength=len(texts))
            found = np.bincount(w.owner, weights=np.log(self.rate[w.word, best[w.owner]] * _LEXICON), minlength=len(texts))
            known = (found / self.usual[best] + _PRIOR_WORDS) / (count + _PRIOR_WORDS)
        return names, np.clip(mass.max(axis=1) / np.maximum(total, 1e-30), 0, 1) * (total > 0), known

    def label(self, text: str) -> list[tuple[str, str]]:
        """Each word of one text with its language."""
        w = Words([text])
        if not len(w):
            return []
        post = self.posterior(w)
        return [(text[a:b], self.names[i]) for a, b, i in zip(w.start.tolist(), w.end.tolist(), post.argmax(axis=1).tolist())]


def train(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> Field:
    """The field learned from text and lang of the rows of docs for which ``learn`` holds; null lang or text is left out.

    Every language is learned, however many there are. Repeated rows count in the lexicon as often as they are there, and
    once in the sample that weights are fitted on: the SAMPLE_DOCS texts of a language whose hashes come first, of each
    the first SAMPLE_CHARS characters. Without any row, no language is learned. Other columns are not read.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("lang", "text").alias("h"))
    counts = {r.lang: r.texts for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()}
    names = sorted(counts)
    number = {x: i for i, x in enumerate(names)}
    n = len(names)
    if not n:
        return Field([], np.zeros((_LEXICON, 0)))
    rate = np.empty((_LEXICON, n))
    for at in range(0, n, BLOCK_LANGUAGES):
        rate[:, at : at + BLOCK_LANGUAGES] = _word_counts(rows, names[at : at + BLOCK_LANGUAGES])
    rate /= np.maximum(rate.sum(axis=0), 1)
    rate += 1e-7
    field = Field(names, np.log(rate / rate.sum(axis=1, keepdims=True)))
    rate /= rate.sum(axis=0)
    field.rate = rate.astype(np.float32)
    del rate
    field.usual = np.array([max(float((x * np.log(x * _LEXICON)).sum()), 1e-9) for x in field.rate.T])
    # hashes below a border that about four times as many texts have; of these, the first ones
    borders = docs.sparkSession.createDataFrame([(name, draw_border(sample_docs, k)) for name, k in counts.items()], rows.select("lang").schema.add("border", "long"))
    start = F.substring("text", 1, SAMPLE_CHARS)
    drawn = rows.join(F.broadcast(borders), "lang").where(F.col("h") <= F.col("border")).groupBy("lang", "h").agg(F.min(start).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = drawn.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "text").orderBy("lang", "rank")
    stretches, truth = [], []
    for lang, text in sample.toLocalIterator():
        parts = _stretches(text)
        stretches += parts
        truth += [number[lang]] * len(parts)
    field.fit(stretches, np.array(truth, np.int64))
    return field


def _word_counts(rows: DataFrame, names: list[str]) -> np.ndarray:
    """How many words of these languages hash into each slot of the lexicon, by language."""
    number = {x: i for i, x in enumerate(names)}
    n = len(names)

    def count(part: pa.Table, texts: list[str]) -> np.ndarray:
        w = Words(texts, lexicon_only=True)
        lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
        return np.bincount(w.word * n + lang[w.owner], minlength=_LEXICON * n).astype(float)

    return summed(rows.where(F.col("lang").isin(names)).select("lang", "text"), _LEXICON * n, count).reshape(_LEXICON, n)


def _stretches(text: str) -> list[str]:
    """A text's parts of BLOCK_WORDS words (the last: what is left), from the first letter of each to its last."""
    w = Words([text], lexicon_only=True)
    first = np.arange(0, len(w), BLOCK_WORDS)
    last = np.minimum(first + BLOCK_WORDS, len(w)) - 1
    return [text[a:b] for a, b in zip(w.start[first].tolist(), w.end[last].tolist())]


def draw_border(wanted: int, texts: int) -> int:
    """The hash (a signed 64-bit number) up to which about four times as many of the texts lie as are wanted."""
    return min((1 << 63) - 1, -(1 << 63) + (4 * wanted << 64) // max(texts, 1))


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id of any type, text); a text without letters, or null: und, 0.

    Of languages with equal shares the first by name counts. Repeated rows come out as often as they go in; other
    columns, such as lang, are not read. Very long texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            names, share = field.predict(texts)
            yield from pa.table({"doc_id": rows.column("doc_id"), "lang_pred": names, "score": share}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, lang_pred string, score double")


def keep_identified(docs: DataFrame, field: Field, least_share: float = LEAST_SHARE, least_evidence: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows of docs, all columns as they are, with letters, a language of at least ``least_share`` of them, and words
    that are known in it: text in a language that was not learned goes.

    If no language could be learned (no row has one), all rows stay.
    """

    def wanted(texts: list[str]) -> np.ndarray:
        names, share, known = field.judge(texts)
        return np.array([x != "und" for x in names], bool) & (share >= least_share) & (known >= least_evidence)

    return keep_rows(docs, wanted) if field.names else docs
