"""Language-model scores of whole texts under a bigram model of the corpus, kept in Elias-Fano tries.

A model of a corpus grows with it, so it is never in one place: it is cut into shards by ranges of word and of pair,
each a small trie in memory-mapped bytes. Texts are dealt into blocks. In a first round a block sends each shard of
words the distinct words that it has there, sorted and delta-coded, with their counts in training texts; a shard adds
up the counts of all blocks and answers in the order of the question. From these a block knows the count and the
smoothed probability of every word that it has. In a second round it sends each shard of pairs its distinct pairs with
their counts, the count of each context and the probability of each second word; the shard smooths, quantises, builds
its trie and answers with a byte a pair. The block reads its texts again and adds up scores. So a word or pair that
every text has costs a shard one entry a block, not one a text.

A shard's trie holds contexts, pointers, successors and quantised smoothed probabilities: SHARE of a pair's count over
its context's and the rest of the add-one probability of the word, in 255 logarithmic steps down to the least one that
there can be. A pair that training does not have gets the rest alone, a context that it does not have the word's own
probability. A frequent context is cut into SLICES by successor, which lie in different shards.

Words and pairs are known by hashes: 64 bits for a word, and for a pair twice ``bits``; of pairs that were never seen,
fewer than one in a million are taken for one that was. Blocks and shards grow with the cube root of a corpus of over
SMALL bytes, so that what one block sends to one shard stays many keys long.

The order is 2: see the README for what triples would add to the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import cut, id_type, partitions
from millrace.llm._text import lower_ascii, mix64, span_hash, utf8, words
from millrace.llm.elias_fano import EliasFano, Trie, mapped
from millrace.llm.packed import added, borders, pack_counts, pack_runs, pack_sorted, sent, unpack_counts, unpack_runs, unpack_sorted

SHARE = 0.5
SLICES = np.uint64(16)
BLOCK_BYTES, MOST_BLOCK_BYTES = 8 << 20, 32 << 20
SHARD_BYTES, MOST_SHARD_BYTES = 64 << 20, 512 << 20
SMALL = 1 << 40
STEPS = 254
END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's followed by END, and the number of the text that each is in."""
    raw, offsets = utf8(texts)
    start, end, owner = words(raw, offsets)
    h = span_hash(lower_ascii(raw), start, end) if len(start) else np.zeros(0, np.uint64)
    last = np.searchsorted(owner, np.arange(len(texts)), side="right")
    return np.insert(h, last, END), np.insert(owner, last, np.arange(len(texts)))


def pairs(h: np.ndarray, owner: np.ndarray, bits: int) -> np.ndarray:
    """The key of every token and the one before it: slice of the context, then the word, ``bits`` bits each."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = owner[1:] != owner[:-1]
    before[first] = BEGIN
    word = h >> np.uint64(64 - bits)
    context = mix64(before ^ (word % SLICES)) >> np.uint64(64 - bits)
    return context << np.uint64(bits) | word


def quantise(p: np.ndarray, least: float) -> np.ndarray:
    """Probabilities from ``least`` to 1 as codes 1..255, in equal steps of their logarithm."""
    return (1 + np.round(STEPS * (1 - np.log(p) / min(math.log(least), -1e-9)))).clip(1, 255).astype(np.uint8)


def dequantised(least: float) -> np.ndarray:
    """The probability of every code (0: none)."""
    out = np.exp((1 - (np.arange(256) - 1) / STEPS) * min(math.log(least), -1e-9))
    out[0] = 0
    return out


def _blobs(table: pa.Table, column: str, unpack) -> np.ndarray:
    return np.concatenate([unpack(x) for x in table.column(column).to_pylist()])


def _grown(base: int, most: int, size: int) -> int:
    return min(most, round(base * max(1.0, size / SMALL) ** (1 / 3)))


def score(docs: DataFrame, learn: Column, share: float = SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id of any type, text).

    The model is learned from the rows for which ``learn`` (of doc_id) holds. n_known counts tokens that training has;
    base_score sums log10((c + 1) / (N + V + 1)), score the model's log10 probabilities. A null text is empty and has
    its end alone; long texts are read whole. Repeated rows count, and come out, as often as they go in. Without
    training rows every token has probability 1. An empty table gives no rows. Columns other than doc_id and text are
    not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions(spark, size)
    shards = max(tasks, -(-size // _grown(SHARD_BYTES, MOST_SHARD_BYTES, size)))
    blocks = max(tasks, -(-size // _grown(BLOCK_BYTES, MOST_BLOCK_BYTES, size)))
    bits = min(32, max(16, -(-(max(size, 1).bit_length() + 18) // 2)))
    word_borders, pair_borders = borders(shards, 64), borders(shards, 2 * bits)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"), block.alias("block")).repartition(tasks, "block")

    def block_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tokens([t or "" for t in table.column("text").to_pylist()])

    def learned(table: pa.Table, owner: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(inverse, weights=np.array(table.column("learn").to_pylist(), bool)[owner], minlength=n).astype(np.int64)

    def ask_words(table: pa.Table) -> pa.Table:
        """What a block asks of the shards of words: (shard, block, keys, counts)."""
        h, owner = block_tokens(table)
        u, inverse = np.unique(h, return_inverse=True)
        counts = learned(table, owner, inverse, len(u))
        at, some = sent(u, word_borders)
        spans = [(int(at[i]), int(at[i + 1])) for i in some]
        return pa.table(
            {
                "shard": pa.array(some, pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()] * len(some), pa.int32()),
                "keys": pa.array([pack_sorted(u[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([pack_counts(counts[a:b]) for a, b in spans], pa.binary()),
            }
        )

    def answer_words(table: pa.Table) -> pa.Table:
        """A shard's answers (block, shard, counts in order); its tokens and distinct tokens come with the first one."""
        asked = table.column("keys").to_pylist()
        keys, counts = np.concatenate([unpack_sorted(x) for x in asked]), _blobs(table, "counts", unpack_counts)
        known = counts > 0
        keys, counts = added(keys[known], counts[known])
        below = keys[0] if len(keys) else np.uint64(0)
        level = EliasFano(mapped(EliasFano.encode(keys - below, int(keys[-1] - below) + 1 if len(keys) else 1)))
        asked = [unpack_sorted(x) for x in asked]
        u, which = np.unique(np.concatenate(asked), return_inverse=True)  # what many blocks ask is looked up once
        at = np.full(len(u), -1, np.int64)
        inside = np.flatnonzero((u >= below) & (u <= keys[-1])) if len(keys) else np.zeros(0, np.int64)
        at[inside] = level.find(u[inside] - below)
        found = (np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(u), np.int64))[which]
        out = [pack_counts(x) for x in np.split(found, np.cumsum([len(q) for q in asked])[:-1])]
        rest = [0] * (len(out) - 1)
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "answer": pa.array(out, pa.binary()), "n": pa.array([int(counts.sum()), *rest], pa.int64()), "v": pa.array([len(keys), *rest], pa.int64())})

    asked = dealt.groupBy("block").applyInArrow(ask_words, "shard int, block int, keys binary, counts binary")
    replies = cut(asked.repartition(tasks, "shard").groupBy("shard").applyInArrow(answer_words, "block int, shard int, answer binary, n long, v long"))
    total, distinct = replies.agg(F.sum("n"), F.sum("v")).first()
    total, normal = total or 0, (total or 0) + (distinct or 0) + 1
    least = (1 - share) / normal
    by_block = replies.select("block", "shard", "answer").groupBy("block")

    def in_order(table: pa.Table, unpack) -> np.ndarray:
        """What all shards have answered, in the order in which it was asked."""
        rows = sorted(zip(table.column("shard").to_pylist(), table.column("answer").to_pylist()))
        return np.concatenate([unpack(b"" if unpack is as_codes else pack_counts(np.zeros(0, np.int64))), *(unpack(x) for _, x in rows)])

    def as_codes(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.uint8)

    def known_words(texts: pa.Table, answers: pa.Table) -> tuple[np.ndarray, ...]:
        """Tokens, their owners, and for each its training count and that of its context."""
        h, owner = block_tokens(texts)
        u, inverse = np.unique(h, return_inverse=True)
        counts = in_order(answers, unpack_counts)
        c = counts[inverse]
        first = np.ones(len(h), bool)
        first[1:] = owner[1:] != owner[:-1]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[first] = counts[np.searchsorted(u, END)]  # as many texts begin as end
        return h, owner, c, before

    def ask_pairs(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """What a block asks of the shards of pairs: keys and counts; of pairs that it has from training texts, codes of
        the second words' probabilities, and the counts of their contexts."""
        h, owner, c, before = known_words(texts, answers)
        u, where, inverse = np.unique(pairs(h, owner, bits), return_index=True, return_inverse=True)
        counts = learned(texts, owner, inverse, len(u))
        alone = quantise((c[where] + 1) / normal, 1 / normal)
        at, some = sent(u, pair_borders)
        rows: dict[str, list] = {"shard": some.tolist(), "block": [texts.column("block")[0].as_py()] * len(some), "keys": [], "counts": [], "alone": [], "contexts": []}
        for a, b in ((int(at[i]), int(at[i + 1])) for i in some):
            own = a + np.flatnonzero(counts[a:b])
            rows["keys"].append(pack_sorted(u[a:b]))
            rows["counts"].append(pack_counts(counts[a:b]))
            rows["alone"].append(alone[own].tobytes())
            rows["contexts"].append(pack_runs(before[where[own]]))
        return pa.table(rows, pa.schema({"shard": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "alone": pa.binary(), "contexts": pa.binary()}))

    def answer_pairs(table: pa.Table) -> pa.Table:
        """A shard's answers: (block, shard, a code for each pair in order)."""
        asked = table.column("keys").to_pylist()
        keys, counts, alone, contexts = [], [], [], []
        for k, n, p, x in zip(asked, *(table.column(c).to_pylist() for c in ("counts", "alone", "contexts"))):
            k, n = unpack_sorted(k), unpack_counts(n)
            own = np.flatnonzero(n)
            keys.append(k[own])
            counts.append(n[own])
            alone.append(np.frombuffer(p, np.uint8))
            contexts.append(unpack_runs(x))
        keys, counts, alone, contexts = (np.concatenate(x) for x in (keys, counts, alone, contexts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.add.reduceat(counts[order], first) if len(keys) else counts
        keys, one = keys[first], order[first]
        smoothed = share * times / np.maximum(contexts[one], 1) + (1 - share) * dequantised(1 / normal)[alone[one]]
        low = np.uint64((1 << bits) - 1)
        trie = Trie(mapped(Trie.encode(keys >> np.uint64(bits), keys & low, quantise(np.minimum(smoothed, 1), least), bits)))
        asked = [unpack_sorted(x) for x in asked]
        u, which = np.unique(np.concatenate(asked), return_inverse=True)  # what many blocks ask is looked up once
        codes = trie.lookup(u >> np.uint64(bits), u & low)[which]
        out = [x.tobytes() for x in np.split(codes, np.cumsum([len(q) for q in asked])[:-1])]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "answer": pa.array(out, pa.binary())})

    def add_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        is_word = np.array(answers.column("level").to_pylist()) == 1
        h, owner, c, before = known_words(texts, answers.filter(pa.array(is_word)))
        codes = in_order(answers.filter(pa.array(~is_word)), as_codes)
        code = codes[np.unique(pairs(h, owner, bits), return_inverse=True)[1]]
        n = texts.num_rows
        alone = (c + 1) / normal
        given = np.where(code > 0, dequantised(least)[code], np.where(before > 0, (1 - share) * alone, alone))
        by_text = lambda x: np.bincount(owner, weights=x, minlength=n)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "n_tokens": np.bincount(owner, minlength=n),
                "n_known": np.bincount(owner[c > 0], minlength=n),
                "train_tokens": pa.array(np.full(n, total), pa.int64()),
                "base_score": by_text(np.log10(alone)),
                "score": by_text(np.log10(given)),
            }
        )

    asked = dealt.groupBy("block").cogroup(by_block).applyInArrow(ask_pairs, "shard int, block int, keys binary, counts binary, alone binary, contexts binary")
    codes = asked.repartition(tasks, "shard").groupBy("shard").applyInArrow(answer_pairs, "block int, shard int, answer binary")
    both = replies.select("block", "shard", "answer", F.lit(1).alias("level")).unionByName(codes.withColumn("level", F.lit(2)))
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(add_up, f"doc_id {id_type(docs)}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
