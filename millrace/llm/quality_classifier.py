"""Quality classifier: random-indexing word vectors, pooled by document, and a small calibrated network.

Words are runs of letters, of digits (known by their length) and of other characters; capitals are kept as a mark.
They are hashed into BUCKETS. Each bucket has a sparse random index vector of +1 and -1; a bucket's word vector is the
sum, over the whole corpus, of the index vectors of the words up to REACH places away. A document's features are the
mean vector of its words, the mean over its distinct words, and three figures of its length and variety. A network with
one hidden layer, in numpy, learns labels from a bounded sample of at most SAMPLE_ROWS labelled rows; a part of the
sample that it has not seen sets the temperature that its probabilities are divided by before the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import id_type
from millrace.llm._sums import keep_rows, summed
from millrace.llm._text import chunks, code_points, mix64, span_hash

BUCKETS = 1 << 13
WIDTH = 32
NONZERO = 4
REACH = 2
SAMPLE_ROWS = 20_000
KEEP_FROM = 0.7

_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """0 white space, 1 lower-case or other letter, 2 digit, 3 anything else, 5 capital, by code point below 0x10000."""
    if not _kinds:
        out = np.full(0x10001, 3, np.uint8)
        for i in range(0x10000):
            ch = chr(i)
            out[i] = 0 if ch.isspace() else 5 if ch.isupper() else 1 if ch.isalpha() else 2 if ch.isdigit() else 3
        _kinds.append(out)
    return _kinds[0]


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word of all texts, and the number of the text that it is in."""
    c, offsets = code_points(texts)
    kind = _kind_table()[np.minimum(c, 0x10000)]
    capital = kind == 5
    broad = kind & 3
    edge = np.ones(len(c) + 1, bool)
    edge[1:-1] = broad[1:] != broad[:-1]
    edge[offsets] = True
    start = np.flatnonzero(edge)
    start, end = start[:-1], start[1:]
    real = broad[start] != 0
    start, end = start[real], end[real]
    unit = np.where(capital & (c < 128), c + 32, c)
    h = span_hash(unit.astype("<u4").view(np.uint8), 4 * start, 4 * end) if len(start) else np.zeros(0, np.uint64)
    digits = broad[start] == 2
    h[digits] = mix64((end - start)[digits].astype(np.uint64))
    capitals = np.zeros(len(c) + 1, np.int64)
    np.cumsum(capital, out=capitals[1:])
    shouted = (capitals[end] - capitals[start] == end - start) & (end - start > 1)
    h ^= shouted.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mix64(h) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.searchsorted(offsets, start, side="right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    rng = np.random.default_rng(1)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_sums(texts: list[str]) -> np.ndarray:
    """Word vectors of these texts alone, flat."""
    word, owner = buckets(texts)
    place, sign = index_vectors()
    out = np.zeros(BUCKETS * WIDTH)
    for step in range(1, REACH + 1):
        same = np.flatnonzero(owner[step:] == owner[:-step]) if len(owner) > step else np.zeros(0, np.int64)
        for a, b in ((word[same], word[same + step]), (word[same + step], word[same])):
            for k in range(NONZERO):
                out += np.bincount(a * WIDTH + place[b, k], weights=sign[b, k], minlength=BUCKETS * WIDTH)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from all texts of docs."""
    sums = summed(docs.select("text"), BUCKETS * WIDTH, lambda _, texts: context_sums(texts)).reshape(BUCKETS, WIDTH)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Pooled features, a row a text; of a text without words all are 0."""
    word, owner = buckets(texts)
    n = len(texts)
    pairs, times = np.unique(owner * BUCKETS + word, return_counts=True)
    of, v = pairs // BUCKETS, vectors[pairs % BUCKETS]
    count, distinct = np.bincount(owner, minlength=n), np.bincount(of, minlength=n)
    out = np.zeros((n, 2 * WIDTH + 3), np.float32)
    has = np.flatnonzero(distinct)
    first = (np.cumsum(distinct) - distinct)[has]
    if len(has):
        out[has, :WIDTH] = np.add.reduceat(v * times[:, None].astype(np.float32), first, axis=0) / count[has, None]
        out[has, WIDTH : 2 * WIDTH] = np.add.reduceat(v, first, axis=0) / distinct[has, None]
        out[has, -3] = np.log1p(count[has])
        out[has, -2] = distinct[has] / count[has]
        out[has, -1] = np.log(distinct[has]) / np.log1p(count[has])
    return out


class Network:
    """Two layers in numpy, with standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 60, batch: int = 128, rate: float = 3e-3):
        rng = np.random.default_rng(3)
        self.temperature, self.constant = 1.0, None
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return
        self.centre, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        order = rng.permutation(len(x))
        calibrate, learn = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.centre) / self.spread
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        mean, square = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
        step = 0
        for _ in range(rounds):
            rng.shuffle(learn)
            for at in range(0, len(learn), batch):
                b = learn[at : at + batch]
                inner = np.tanh(z[b] @ p[0] + p[1])
                slope = (1 / (1 + np.exp(-(inner @ p[2] + p[3]))) - y[b]) / len(b)
                deep = slope[:, None] * p[2] * (1 - inner**2)
                grads = [z[b].T @ deep + 1e-4 * p[0], deep.sum(axis=0), inner.T @ slope + 1e-4 * p[2], slope.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    mean[i] += 0.1 * (g - mean[i])
                    square[i] += 0.001 * (g * g - square[i])
                    p[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = p
        if len(calibrate):
            logits, truth = self.logits(x[calibrate]), y[calibrate]
            losses = {t: np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean() for t in np.geomspace(0.25, 8, 60)}
            self.temperature = min(losses, key=losses.get)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.spread @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


class Classifier:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, texts: list[str]) -> np.ndarray:
        return self.network.score(features(texts, self.vectors)).astype(float)


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """The classifier for labels (doc_id, quality); ``learn`` says of a doc_id whether its label may be learned.

    Labels of one doc_id that differ count as the lower; null labels and those of absent documents are left out. Of
    rows that share a doc_id one is learned from, the first by its features; all of them count for the word vectors.
    Labels beyond sample_rows are drawn by a hash of the doc_id. Null texts count as empty, very long ones are read
    whole. Without any label, or any document, every score is 0.5. Other columns are not read.
    """
    vectors = word_vectors(docs)
    usable = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the bound of the broadcast below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            x = features(texts, vectors)
            yield from pa.table({"doc_id": rows.column("doc_id"), "quality": rows.column("quality").cast(pa.int64()), "x": pa.array([r.tobytes() for r in x], pa.binary())}).to_batches()

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    learned = joined.mapInArrow(run, f"doc_id {id_type(docs)}, quality long, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    rows = sorted(map(tuple, learned.collect()))  # at most sample_rows
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64).reshape(len(rows), 2 * WIDTH + 3)
    return Classifier(vectors, Network(x, np.array([float(r[1] > 0) for r in rows])))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, score of every row of docs (doc_id of any type, text).

    Null and empty texts have the score of a text without words; equal texts have equal scores, very long ones are read
    whole. Repeated rows come out as often as they go in, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            yield from pa.table({"doc_id": rows.column("doc_id"), "score": classifier.score(texts)}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, score double")


def keep_good(docs: DataFrame, classifier: Classifier, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least ``keep_from``; all, if no label was learned."""
    if classifier.network.constant is not None:
        return docs
    return keep_rows(docs, lambda texts: classifier.score(texts) >= keep_from)
