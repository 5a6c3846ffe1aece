"""Texts alike by the Jaccard similarity of their word shingles: an exact join, not a sample of pairs.

A text is the set of its shingles' 64-bit hashes; equal sets are one node. Sets are read in one order for all texts,
the shingles that few texts have first. If two sets of x and y shingles are alike by t or more, they have at least
ceil(t (x + y) / (1 + t)) in common, so the first x - ceil(t x) + 1 of one and the first y - ceil(t y) + 1 of the other
meet (prefix filter). Texts are joined on these, pairs that sizes or places rule out are left, and of the others the
whole sets are compared. For the order, the number of sets that have each shingle is counted exactly; shingles that one
set has alone, as most are, come first and meet nothing, so lines and passages that texts share stay out of the join.

A set also has BITS parity bits: bit i tells whether an odd number of its shingles fall on i. Two sets differ in at
least as many shingles as parity bits, so most pairs that are not alike are seen within a group, without their sets.

Copies do not meet in all pairs: first each group gives a spanning forest of the pairs that are not ruled out, by the
fewest differing bits, and these are verified; then only pairs that are still in two components, which is what is left
when a pair of a forest was not alike, are verified too. A group has a bounded number of rows (``graph.tiled``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import cut, discard, partitions
from millrace.llm._text import chunks, mix64, release
from millrace.llm.graph import bounds, components, spanning, tiled, whole_groups
from millrace.llm.packed import added, borders, pack_counts, pack_sorted, sent, unpack_counts, unpack_sorted
from millrace.llm.shingles import hashes

BITS = 512
#: Bytes of text in one block, and for which one shard answers.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 32 << 20
_SLOT_BITS = (1 << 23) - 1
#: Pairs compared at once.
_BLOCK = 1 << 17
#: Groups of more rows are handed on whole; of smaller ones, only rows that another may be alike.
_SIFTED = 4096
#: Nodes that a task remembers to have sent.
_REMEMBERED = 500_000


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in order, with offsets, and each set's node."""
    h, text = hashes(texts, size)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[fresh], text[fresh]
    count = np.bincount(text, minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(count)])
    total = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        total[some] = np.add.reduceat(mix64(h), offsets[:-1][some])
    with np.errstate(over="ignore"):
        node = mix64(total + count.astype(np.uint64))
    return h, offsets, node.view(np.int64)


def nodes(texts: list[str], size: int) -> np.ndarray:
    """The node of every text's set of shingles (null and wordless texts: that of no shingles)."""
    return shingle_sets(texts, size)[2]


def parity(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity bits of every set, a row of BITS / 8 bytes each."""
    out = np.zeros((len(offsets) - 1, BITS // 8), np.uint8)
    at = ((h >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)
    for i in range(0, len(out), 2048):
        j = min(i + 2048, len(out))
        inside = slice(offsets[i], offsets[j])
        owner = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        times = np.bincount(owner * BITS + at[inside], minlength=(j - i) * BITS).reshape(j - i, BITS)
        out[i:j] = np.packbits((times & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def needed(n: np.ndarray, t: int) -> np.ndarray:
    """ceil(t / 100 x n)."""
    return -(-t * n // 100)


def _class(often: np.ndarray) -> np.ndarray:
    """How many sets have a shingle, as a byte: 0 for one, else in steps of an eighth of a power of two."""
    return np.minimum(np.ceil(8 * np.log2(np.maximum(often, 1))), 255).astype(np.uint8)


def _prefixes(docs: DataFrame, size: int, t: int) -> DataFrame:
    """key, node, n, place: of every distinct set the shingles of its prefix that another set has too.

    Texts are dealt into blocks; a block asks shards of shingles how many sets have each of its own (keys of as many
    bits as hardly collide; a collision only moves both shingles back in the order), and is answered a byte a key.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions(docs.sparkSession, total)
    blocks, shards = max(tasks, -(-total // BLOCK_BYTES)), max(tasks, -(-total // SHARD_BYTES))
    bits = min(64, max(32, total.bit_length() + 13))
    edges = borders(shards, bits)

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of copies, one a task goes on
        for rows, texts in chunks(batches):
            node = nodes(texts, size)
            new = []
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    new.append(i)
                    seen.add(x)
            if len(seen) > _REMEMBERED:
                seen.clear()
            yield from pa.table({"node": node[new], "text": [texts[i] for i in new], "block": (node[new] % blocks).astype(np.int64)}).to_batches(max_chunksize=1000)

    def block_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        release()  # what the block before has used
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        texts = table.column("text").to_pylist()
        h, offsets, _ = shingle_sets([texts[i] for i in first.tolist()], size)
        return h, offsets, node

    def ask(table: pa.Table) -> pa.Table:
        h, _, _ = block_sets(table)
        u, often = np.unique(h >> np.uint64(64 - bits), return_counts=True)
        at, some = sent(u, edges)
        spans = [(int(at[i]), int(at[i + 1])) for i in some]
        columns = {"keys": [pack_sorted(u[a:b]) for a, b in spans], "counts": [pack_counts(often[a:b]) for a, b in spans]}
        return pa.table({"shard": pa.array(some, pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * len(some), pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in columns.items()}})

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        keys, often = added(np.concatenate(asked), np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()]))
        rank = _class(often)
        out = [rank[np.searchsorted(keys, q)].tobytes() for q in asked]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "answer": pa.array(out, pa.binary())})

    def emit(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, offsets, node = block_sets(table)
        replies = sorted(zip(answers.column("shard").to_pylist(), answers.column("answer").to_pylist()))
        known = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for _, x in replies)])
        rank = known[np.unique(h >> np.uint64(64 - bits), return_inverse=True)[1]]
        n = np.diff(offsets)
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, rank, of))
        place = np.arange(len(h)) - offsets[:-1][of]
        prefix = n - needed(n, t) + 1
        keep = (place < prefix[of]) & (rank[order] > 0)  # what no other set has meets nothing
        of = of[keep]
        return pa.table({"key": h[order][keep].view(np.int64), "node": node[of], "n": n[of].astype(np.int32), "place": place[keep].astype(np.int32)})

    dealt = docs.select("text").mapInArrow(first_ones, "node long, text string, block long").repartition(tasks, "block")
    asked = dealt.groupBy("block").applyInArrow(ask, "shard long, block long, keys binary, counts binary")
    replies = asked.repartition(tasks, "shard").groupBy("shard").applyInArrow(answer, "block long, shard long, answer binary")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(emit, "key long, node long, n int, place int")


def _possible(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether sizes and places allow a likeness of t hundredths, if this is the first shingle that a and b share."""
    x, y = n[a], n[b]
    common = np.minimum(x - place[a], y - place[b])
    return (t * np.maximum(x, y) <= 100 * np.minimum(x, y)) & ((100 + t) * common >= t * (x + y))


def _sift(t: int):
    """Of sorted groups, rows of distinct nodes that another row may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = None  # the key of a group that comes in pieces: all its rows are handed on
        for table in whole_groups(batches, _SIFTED):
            key, tile, node, n, place = (table.column(c).to_numpy() for c in ("key", "tile", "node", "n", "place"))
            n, place = n.astype(np.int64), place.astype(np.int64)
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])
            key, tile, node, n, place = (x[fresh] for x in (key, tile, node, n, place))
            cut_at = bounds(key, tile)
            size = np.diff(cut_at)
            keep = np.zeros(len(key), bool)
            two = cut_at[:-1][size == 2]
            two = two[_possible(n, place, two, two + 1, t)]
            keep[two] = keep[two + 1] = True
            for s, m in zip(cut_at[:-1][size > 2].tolist(), size[size > 2].tolist()):
                if m > _SIFTED:
                    keep[s : s + m] = True
                    continue
                step = max(1, _BLOCK // m)
                for i in range(0, m, step):
                    a = np.arange(i, min(i + step, m))[:, None]
                    ok = _possible(n[s : s + m], place[s : s + m], a, np.arange(m)[None, :], t) & (a != np.arange(m))
                    keep[s + i : s + i + len(a)] |= ok.any(axis=1)
            if large is not None:
                keep |= key == large
            if key[0] == key[-1] and table.num_rows > _SIFTED:
                large = key[0]
                keep[:] = True
            yield pa.RecordBatch.from_pydict({"key": key[keep], "node": node[keep], "n": n[keep].astype(np.int32), "place": place[keep].astype(np.int32)})

    return run


def _pairs(t: int, forest: bool):
    """Of groups, the pairs (a, b) of two components that sizes, places and parity bits allow; or a forest of them."""

    def group(node, n, place, label, bits) -> Iterator[pa.RecordBatch]:
        _, first, own = np.unique(label, return_index=True, return_inverse=True)
        if len(first) == 1:
            return
        m, label = len(node), first[own]
        held = [np.zeros((2, 0), np.int64)]
        weights = [np.zeros(0, np.uint64)]
        step = max(1, _BLOCK // m)
        for i in range(0, m, step):
            a, b = np.nonzero((label[i : i + step, None] != label[None, :]) & (np.arange(i, min(i + step, m))[:, None] < np.arange(m)[None, :]))
            a = a + i
            ok = _possible(n, place, a, b, t)
            a, b = a[ok], b[ok]
            apart = np.zeros(len(a), np.int64)
            for k in range(0, len(a), _BLOCK // 8):
                part = slice(k, k + _BLOCK // 8)
                apart[part] = np.bitwise_count(bits[a[part]] ^ bits[b[part]]).sum(axis=1)
            ok = (100 + t) * apart <= (100 - t) * (n[a] + n[b])  # alike sets have (1 - t) / (1 + t) (x + y) apart at most
            a, b, apart = a[ok], b[ok], apart[ok]
            if not forest:
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})
                continue
            with np.errstate(over="ignore"):
                tie = mix64((node[a] ^ node[b]).view(np.uint64)) >> np.uint64(16)  # the same in every group
            held = [np.concatenate([held[0], np.stack([a, b])], axis=1)]
            weights = [np.concatenate([weights[0], apart.astype(np.uint64) << np.uint64(48) | tie])]
            best = spanning(label, *held[0], weights[0])
            held, weights = [held[0][:, best]], [weights[0][best]]
        a, b = held[0]
        if len(a):
            yield pa.RecordBatch.from_pydict({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, tile, node, n, place, label = (table.column(c).to_numpy() for c in ("key", "tile", "node", "n", "place", "label"))
            blobs = pa.chunked_array(table.column("bits").chunks).combine_chunks()
            bits = np.frombuffer(b"".join(blobs.to_pylist()), np.uint64).reshape(len(key), BITS // 64)
            n, place, cut_at = n.astype(np.int64), place.astype(np.int64), bounds(key, tile)
            for s, e in zip(cut_at[:-1].tolist(), cut_at[1:].tolist()):
                if e - s > 1:
                    yield from group(node[s:e], n[s:e], place[s:e], label[s:e], bits[s:e])

    return run


def linked_nodes(docs: DataFrame, size: int, least: float, near: DataFrame | None = None) -> DataFrame:
    """node, component of every node that some other is linked to: all pairs alike by ``least`` or more.

    near: pairs (a, b) of nodes that are likely to be alike; they are verified first.
    """
    t = round(100 * least)
    texts = docs.select("text")

    def whole(wanted: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in chunks(batches):
                h, offsets, node = shingle_sets(texts, size)
                _, one = np.unique(node, return_index=True)
                of = one[wanted[(node[one] & _SLOT_BITS) >> 3] >> (node[one] & 7) & 1 == 1]
                bits = parity(h, offsets)
                for i in range(0, len(of), 200):
                    part = of[i : i + 200]
                    sets = pa.array([h[offsets[k] : offsets[k + 1]].view(np.int64) for k in part.tolist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict({"node": node[part], "bits": pa.array([bits[k].tobytes() for k in part.tolist()], pa.binary()), "hashes": sets})

        return run

    rows = _prefixes(docs, size, t).withColumn("tile", F.lit(0)).repartition("key").sortWithinPartitions("key", "node")
    rows = cut(rows.mapInArrow(_sift(t), "key long, node long, n int, place int"))
    pairs = cut(near.distinct()) if near is not None else None
    ends = [F.explode(F.array("a", "b")).alias("node")]
    # a map of bits leaves the sets of most other texts out of the shuffle; those that it lets through in error meet no pair
    used = rows.select("node") if pairs is None else rows.select("node").unionAll(pairs.select(*ends))
    bits = np.zeros(_SLOT_BITS + 1, bool)
    bits[used.select(F.col("node").bitwiseAND(_SLOT_BITS).alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    sets = cut(texts.mapInArrow(whole(np.packbits(bits, bitorder="little")), "node long, bits binary, hashes array<long>").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are alike."""
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y")).cast("long")
        return cut(both.where(100 * common >= t * (F.size("x") + F.size("y") - common)).select("a", "b"))

    def candidates(found: DataFrame | None, forest: bool) -> DataFrame:
        known = sets.select("node", "bits")
        known = known.withColumn("label", F.col("node")) if found is None else known.join(found, "node", "left").select("node", "bits", F.coalesce("component", "node").alias("label"))
        return cut(tiled(rows.join(known, "node")).select("key", "tile", "node", "n", "place", "label", "bits").mapInArrow(_pairs(t, forest), "a long, b long").distinct())

    links, found = [], None
    if pairs is not None:
        links.append(verified(pairs))
        found = components(links[0])
    first = candidates(found, True)
    links.append(verified(first))
    found = components(reduce(DataFrame.unionByName, links))
    rest = candidates(found, False)
    links.append(verified(rest.join(first, ["a", "b"], "left_anti")))
    out = components(reduce(DataFrame.unionByName, links))
    discard(rows, sets, first, rest, found, *links, *([pairs] if pairs is not None else []))
    return out
