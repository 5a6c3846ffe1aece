"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Each segment, with zeros before it, is a word of the
perfect binary Golay code [23, 12, 7]: every word lies within 3 bits of exactly one codeword. A word at distance 3 may
change codeword when one bit flips, and then only to one of five others; so a word has one key or six, the codewords
of itself and of its one-bit neighbours, and two words that differ in one bit (even in two) share a key.

Two fingerprints that differ in at most 2 bits agree wholly on one segment. If the two bits fall into one segment, both
others agree; else each other segment differs in one bit at most. Hence one of the pairs (first exact, second fuzzy),
(second, third), (third, first) has an equal exact segment and a shared key of the fuzzy one: fingerprints are joined
on (pair, exact segment, key), and links are verified by their true distance.

Equal fingerprints are one node, so copies never meet each other, and from each joined group only a spanning forest
comes out, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from millrace.llm import shingle_join
from millrace.llm._spark import cut, id_type
from millrace.llm._text import chunks
from millrace.llm.graph import bounds, components, joined, tiled, whole_groups
from millrace.llm.shingles import hashes

SHINGLE_WORDS = 3
NEAR_BITS = 2
#: What the pipeline's stage takes for near copies.
KEEP_SHINGLE_WORDS = 5
KEEP_SIMILARITY = 0.8
#: Groups of more fingerprints look up each one's neighbours instead of comparing blocks.
BLOCK_GROUP = 4096
_WIDTHS = (22, 21, 21)
_SHIFTS = (42, 21, 0)
#: Of the code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101

_SPREAD = np.array([sum(1 << 8 * k for k in range(8) if v >> k & 1) for v in range(256)], np.uint64)


def fingerprints(texts: list[str], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprint of every text: a bit is set if it is in over half the shingles' hashes."""
    h, text = hashes(texts, shingle_words)
    out = np.zeros(len(texts), np.uint64)
    if not len(h):
        return out
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    blocks = -(-count // 255)  # sums of up to 255 bits fit into a byte
    block_text = np.repeat(np.arange(len(texts)), blocks)
    begin = first[block_text] + 255 * (np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    by_byte = h.view(np.uint8).reshape(-1, 8)
    ones = np.zeros((len(texts), 64), np.int64)
    has = np.flatnonzero(blocks)
    block_first = (np.cumsum(blocks) - blocks)[has]
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[by_byte[:, k]], begin)
        ones[has, 8 * k : 8 * k + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), block_first, axis=0)
    bits = 2 * ones > count[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


_golay: list[np.ndarray] = []


def golay_index() -> np.ndarray:
    """The index of the nearest codeword of every 23-bit word."""
    if not _golay:
        message = np.arange(4096)
        rest = message << 11
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ _GENERATOR << bit - 11, rest)
        code = message << 11 | rest
        flip = [0]
        for a in range(23):
            flip.append(1 << a)
            for b in range(a):
                flip.append(1 << a | 1 << b)
                flip.extend(1 << a | 1 << b | 1 << c for c in range(b))
        table = np.empty(1 << 23, np.int16)
        for e in flip:
            table[code ^ e] = message
        _golay.append(table)
    return _golay[0]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints, and which fingerprint each belongs to."""
    index = golay_index()
    segment = [(fp >> np.uint64(s)).astype(np.int64) & (1 << w) - 1 for s, w in zip(_SHIFTS, _WIDTHS)]
    out, of = [], []
    for pair, (exact, fuzzy) in enumerate(((0, 1), (1, 2), (2, 0))):
        word = segment[fuzzy]
        near = np.stack([index[word]] + [index[word ^ 1 << b] for b in range(_WIDTHS[fuzzy])], axis=1).astype(np.int64)
        near.sort(axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(fresh)
        out.append(pair << 40 | segment[exact][row] << 12 | near[row, column])
        of.append(row)
    return np.concatenate(out), np.concatenate(of)


def linked(fp: np.ndarray, near: int = NEAR_BITS) -> np.ndarray:
    """For each of the distinct fingerprints of a group, the lowest position that links lead to."""
    n = len(fp)
    label = np.arange(n)
    if n <= BLOCK_GROUP:
        step = max(1, (1 << 18) // n)
        for i in range(0, n, step):
            a, b = np.nonzero(np.bitwise_count(fp[i : i + step, None] ^ fp[None, :]) <= near)
            label = joined(label, a + i, b)
        return label
    order = np.argsort(fp)
    ranked = fp[order]
    single = [1 << i for i in range(64)]
    masks = single + [x | y for i, x in enumerate(single) for y in single[:i]]
    for m in masks:
        other = ranked ^ np.uint64(m)
        at = np.minimum(np.searchsorted(ranked, other), n - 1)
        hit = np.flatnonzero(ranked[at] == other)
        label = joined(label, order[hit], order[at[hit]])
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges (a, b) of each group of equal (key, tile) between nodes; rows come sorted by group."""
    for table in whole_groups(batches):
        key, tile, fp, node = (table.column(c).to_numpy() for c in ("key", "tile", "fp", "node"))
        fp, cut_at = fp.view(np.uint64), bounds(key, tile)
        size = np.diff(cut_at)
        two = cut_at[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= NEAR_BITS]
        a, b = [node[near]], [node[near + 1]]
        for s, m in zip(cut_at[:-1][size > 2].tolist(), size[size > 2].tolist()):
            label = linked(fp[s : s + m])
            other = np.flatnonzero(label != np.arange(m))
            a.append(node[s + other])
            b.append(node[s + label[other]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row of docs (doc_id of any type, text); null and wordless texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            yield from pa.table({"doc_id": rows.column("doc_id"), "fp": fingerprints(texts, shingle_words).view(np.int64)}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, fp long")


def links(prints: DataFrame) -> DataFrame:
    """a, b: of nodes with fingerprints (node, fp), pairs that hold together all nodes that links of at most NEAR_BITS
    bits lead to: a spanning forest of each group of equal Golay keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = b.column("fp").to_numpy(), b.column("node").to_numpy()
            key, of = keys(fp.view(np.uint64))
            yield from pa.table({"key": key, "fp": fp[of], "node": node[of]}).to_batches()

    keyed = prints.select("node", "fp").mapInArrow(emit, "key long, fp long, node long")
    return tiled(keyed).mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id of any type, text).

    component_id is the smallest doc_id that links of at most 2 bits lead to, through rows with and without a doc_id; a
    null doc_id counts for no component's smallest, and where a component has no other it is null. Rows that share a
    doc_id are rows of their own, linked only by their fingerprints. Columns other than doc_id and text are not read.
    An empty table gives no rows.
    """
    prints = cut(fingerprint(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp")))
    grouped = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "smallest", F.coalesce("component", "fp").alias("component"))
    named = grouped.groupBy("component").agg(F.min("smallest").alias("component_id"))
    groups = grouped.join(named, "component").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = KEEP_SHINGLE_WORDS, similarity: float = KEEP_SIMILARITY) -> DataFrame:
    """The rows of docs (doc_id, text), all columns as they are, with one row of each group of near-duplicates.

    Texts are linked if their sets of shingles of ``shingle_words`` words have a Jaccard similarity of at least
    ``similarity`` (taken to two places); texts with the same set, as all wordless and null ones, are linked too. Links
    are first found by the Golay keys of fingerprints of these shingles and verified by the sets. Most texts at 0.8
    differ in more than 2 of 64 bits, so the links between texts that are not yet in one group are then found by an
    exact join (``shingle_join``): no link is lost.

    Of a group the row with the smallest doc_id stays; rows with that doc_id are ordered by their set and then by a
    hash of all columns, and rows that are the same in all of them are one. Rows without a doc_id all stay and link
    nothing. An empty table gives no rows.
    """
    known = docs.where("doc_id is not null")
    mark = "_mark"
    while mark in docs.columns:
        mark += "_"
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    marked = known.withColumn(mark, F.xxhash64(*hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            columns = {"doc_id": rows.column("doc_id"), "mark": rows.column("mark"), "node": shingle_join.nodes(texts, shingle_words), "fp": fingerprints(texts, shingle_words).view(np.int64)}
            yield from pa.table(columns).to_batches()

    prints = cut(marked.select("doc_id", "text", F.col(mark).alias("mark")).mapInArrow(run, f"doc_id {id_type(docs)}, mark long, node long, fp long"))
    near = links(prints.groupBy("node").agg(F.min("fp").alias("fp")))
    found = shingle_join.linked_nodes(known, shingle_words, similarity, near)
    groups = prints.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = groups.groupBy("component").agg(F.min(F.struct("doc_id", "node", "mark")).alias("head")).select("head.doc_id", F.col("head.mark").alias(mark))
    kept = marked.join(heads, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
