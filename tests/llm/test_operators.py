"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import graph, language_id, ngram_lm, packing, quality_classifier, quality_rules, simhash, token_codec, token_file, url_filter, winnow
from millrace.llm._spark import held_out
from millrace.llm._text import chunks
from millrace.llm.bpe import BytePairEncoder
from millrace.llm.elias_fano import EliasFano, Trie, mapped
from millrace.llm.xxh import xxh64

AWKWARD = [
    (7, "It isn't 12 o'clock yet; we'll see, they've gone."),
    (3, None),
    (5, ""),
    (9, " \t\n "),
    (2, "ÀÉÎ straße İstanbul 日本語 \u200b x"),
    (11, "same text here for you and me"),
    (12, "same text here for you and me"),
    (12, "same text here for you and me"),
    (4, "word " * 6000 + "aaaaaaaaaaaaaaa <|endoftext|> b"),
    (None, "no id at all"),
    (8, "x"),
    (6, "l'été à Zürich, ñandú & Œuvre -- 1999's \"quote\" #1\r\nline two  \n\n line three"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 0.5, "k") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, part string").repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def words_of(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def thue_morse(n, pair):
    """Letters of a structured text; those of the pair turned round collide with it under polynomial hashes modulo 2**64."""
    return "".join(pair[i.bit_count() % 2] for i in range(n))


def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_is_the_library_s(name, library):
    rng = np.random.default_rng(5)
    parts = ["the", " ", "  ", "\n", "'s", "'", "'re", "É", "ß", "12", "a1b", "...", "&&&", "Zürich", "\t", "don't", "ǅ", "—", "é", "ll", "THE", "x" * 30]
    parts += ["“", "”", "It’s", "日本語", "привет", "МИР", "ΣΑΣ", "e\u0301", "\u0301", "İ", "ﬀ", "한국", "\u1112\u1161\u11ab", "क\u093c", "😀", "\u200d", "\xa0", "\u2028", "\u3000", "½", "²", "٣", "Ⅷ", "\u0345", "\x00", "\x1c"]
    parts += ["<|endoftext|>", "<|startoftext|>", "<|endof", "\u0378", "\u1ac3", "Ꮳ", "\U0001f1e6"]
    texts = [t or "" for _, t in AWKWARD] + ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(800)]
    letters = [chr(i) for i in range(0x20, 0x3000)]
    texts += ["".join(rng.choice(letters, 12)) for _ in range(2000)]
    texts += [thue_morse(n, p) + x + thue_morse(n, p[::-1]) for n in (1024, 2048, 8192) for p in ("ab", "en", "st") for x in ("", " ")]
    ours = BytePairEncoder(public_tokenizers.path(name))
    ids, at = ours.encode(texts)
    expected = library[name].encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in expected]
    for e in expected[:300]:
        assert ours.decode(e.ids) == library[name].decode(e.ids, skip_special_tokens=False)
    one, two = thue_morse(4096, "st"), thue_morse(4096, "ts")  # in two calls, by the kept fragments
    for t in (one, two):
        assert ours.encode([t])[0].tolist() == library[name].encode(t, add_special_tokens=False).ids


def test_other_vocabulary_files_are_refused(tmp_path):
    import json

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="known form"):
        BytePairEncoder(str(tmp_path / "other.json"))


def test_distinct_spans_are_told_apart_by_bytes(monkeypatch):
    from millrace.llm import _text

    monkeypatch.setattr(_text, "xxh64", lambda data, start, length: np.zeros(len(start), np.uint64))  # all collide
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(0, 14, 300)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    number, first = _text.distinct(data, end - [len(w) for w in words], end)
    assert [words[first[k]] for k in number] == words and len(first) == len(set(words))


def test_op10_round_trip(docs, library):
    path, t = public_tokenizers.path("word_bpe_49k.json"), library["word_bpe_49k.json"]
    rows = token_codec.digests(docs, path).collect()
    expected = []
    for i, text in AWKWARD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert token_codec.digests(empty(docs), path).count() == 0
    both = token_codec.decode(token_codec.encode(docs, path), path).where("doc_id = 11").first()
    assert both.decoded.split()[0].startswith("same")


def test_op3_files(spark, docs, library, tmp_path):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library["byte_bpe_50k.json"]
    out = str(tmp_path / "tokens")
    token_file.write(docs, out, path)
    ordered = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    start, expected = 0, []
    for i, text in ordered:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        expected.append((i, start, len(ids), zlib.crc32(u32(ids))))
        start += len(ids)
    rows = [tuple(r) for r in token_file.digests(spark, out).collect()]
    assert sorted(rows, key=lambda r: r[1]) == expected
    meta = {(r.doc_id, r.start): r.n_tokens for r in token_file.read_metadata(spark, out).collect()}
    assert meta == {(i, s): n for i, s, n, _ in expected}
    assert {r.doc_id for r in token_file.read_tokens(spark, out, 5, 8).collect()} == {5, 6, 7, 8}
    token_file.write(empty(docs), out, path)
    assert token_file.digests(spark, out).count() == 0
    plan = token_file.read_metadata(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan.split("ReadSchema")[1].split(">")[0]


def test_op3_pages_outside_a_range_are_not_read(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 60))) for i in range(4000)]
    out = str(tmp_path / "pages")
    token_file.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), out, public_tokenizers.path("byte_bpe_50k.json"), page_bytes=4096)
    files = sorted((tmp_path / "pages").glob("*.parquet"))
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(1)
    assert column.path_in_schema == "doc_id" and column.has_column_index and column.has_offset_index
    found = token_file.read_tokens(spark, out, 1000, 1010)
    assert sorted(r.doc_id for r in found.collect()) == list(range(1000, 1011))
    plan = found._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().get("numOutputRows").get().value() < 1500


def test_hot_ids_are_dealt(spark, library, tmp_path):
    rows = [(None, f"text {i} of none") for i in range(300)] + [(7, f"text {i} of seven") for i in range(300)] + [(1, "a")] * 30
    out = str(tmp_path / "hot")
    token_file.write(spark.createDataFrame(rows, "doc_id long, text string"), out, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(token_file.digests(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [1] * 30 + [7] * 300
    crc = lambda t: zlib.crc32(u32(library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids + [0]))
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(t) for _, t in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_very_long_texts(spark, library):
    text = "The quick brown fox, and l'été — jumps 12 times over\n" * 30_000  # more than a chunk
    docs = spark.createDataFrame([(1, text, "en"), (2, text[:-1] + "!", "en"), (3, "short", "en")], "doc_id long, text string, lang string")
    path, t = public_tokenizers.path("word_bpe_49k.json"), library["word_bpe_49k.json"]
    ids = {r.doc_id: r for r in token_codec.digests(docs, path).collect()}
    assert ids[1].ids_sha256 == hashlib.sha256(u32(t.encode(text, add_special_tokens=False).ids)).hexdigest()
    assert sum(r.length for r in packing.pack(docs, path).collect()) == sum(r.n_tokens for r in ids.values()) + 3
    rules = {r.doc_id: r for r in quality_rules.apply_rules(docs, [public_tokenizers.path("byte_bpe_50k.json")]).collect()}
    assert (rules[1].n_words, rules[1].n_dup_lines) == (330_000, 29_999)
    assert len({r.component_id for r in simhash.near_duplicates(docs).where("doc_id < 3").collect()}) == 1
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 3}
    assert {r.n_chars for r in winnow.compare_edited(docs).collect()} == {len(text), 5}
    field = language_id.train(docs, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, field).collect()} == {"en"}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    repeated = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 3"))
    scores = quality_classifier.score(repeated, quality_classifier.train(repeated, labels, F.lit(True))).collect()
    assert len(scores) == 5 and len({r.score for r in scores if r.doc_id == 3}) == 1


def test_op9_packs_every_piece_once(docs, library):
    t = library["word_bpe_49k.json"]
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    pieces = []
    for i, text in AWKWARD:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        pieces += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(u32(ids[s : s + 4096]))) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, pieces))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(p[3] for p in pieces) // 4096)
    assert packing.pack(empty(docs), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, 1 + rng.geometric([0.05, 0.02, 0.2, 0.01][seed], 3000))
    counts = np.bincount(lengths, minlength=65)
    used = np.zeros(65, int)
    for sizes, m in packing.plan(counts, 64):
        assert sum(sizes) <= 64
        for x in sizes:
            used[x] += m
    assert (used == counts).all()
    total = sum(m for _, m in packing.plan(counts, 64))
    bound = max(-(-int(lengths.sum()) // 64), int((lengths > 32).sum()))
    assert total <= 1.02 * bound + 1


def test_xxh64():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start, length = rng.integers(0, 2500, 500), rng.integers(0, 200, 500)
    got = xxh64(data, start, length, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, length)]


def brute_print(text):
    w = words_of(text)
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    """The smallest doc_id that each (doc_id, fingerprint) leads to over links of at most two bits (None: none has one)."""
    label = list(range(len(prints)))
    change = True
    while change:
        change = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if label[j] > label[i] and (a ^ b).bit_count() <= 2:
                    label[j], change = label[i], True
    ids = {}
    for (i, _), x in zip(prints, label):
        ids.setdefault(x, []).append(i)
    return [min((i for i in ids[x] if i is not None), default=None) for x in label]


def test_op2_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(40)]
    texts = list(base)
    for i in range(160):
        w = base[i % 12].split()
        w[int(rng.integers(0, 60))] = f"n{i}"
        texts.append(" ".join(w))
    texts += [base[0], "", None, " ", "A b", "a B", base[1].upper()]
    rows = [(100 + 7 * i % 1009, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == dict(prints)
    assert [got[i].component_id for i, _ in prints] == brute_components(prints)
    # null, repeated and clashing ids: chains may lead through them
    rows = [(None if k % 5 == 0 else i % 40, t) for k, (i, t) in enumerate(rows)] + [(None, "only these words have no id"), (3, "two texts"), (3, "of one id")]
    prints = [(i, brute_print(t)) for i, t in rows]
    found = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, found)) == sorted(map(str, ((*p, c) for p, c in zip(prints, brute_components(prints)))))
    named = [(None if i is None else f"n{i:03}", t) for i, t in rows]
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(named, "doc_id string, text string")).collect()]
    assert sorted(map(str, found)) == sorted(str((None if i is None else f"n{i:03}", None if c is None else f"n{c:03}")) for (i, _), c in zip(prints, brute_components(prints)))


def test_op2_awkward_rows(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(AWKWARD) and all(len(r.fingerprint) == 16 for r in rows)
    assert {r.component_id for r in rows if r.doc_id in (3, 5, 9)} == {3}
    assert {r.component_id for r in rows if r.doc_id in (11, 12)} == {11}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (2, 3, 4, 6, 7, 8, 11, None)))
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_pipeline_keeps_one_of_five_word_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        for edits in range(9):  # each edit inside changes 5 shingles of 146
            w = list(base)
            for k in rng.choice(150, edits, replace=False):
                w[k] = f"n{rng.integers(0, 1 << 40)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(["one line that all have in common here"] * 2 + [f"u{i}v{j}" for j in range(40)])) for i in range(30)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = {i: i for i, _ in rows}
    change = True
    while change:
        change = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] > label[i] and 10 * len(a & b) >= 8 * len(a | b):
                    label[j], change = label[i], True
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = {i for i, x in label.items() if i == x}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == expected
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) > len(expected)
    monkeypatch.setattr(graph, "MOST_TOGETHER", 5)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == expected
    clash = docs.selectExpr("doc_id", "text", "doc_id % 2 AS node", "'m' AS _mark", "1 AS component")
    assert simhash.keep_one(clash).columns == clash.columns and {r.doc_id for r in simhash.keep_one(clash).collect()} == expected


def test_keep_one_of_clashing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, text), (5, other), (6, text + " x"), (7, other + " y"), (5, text), (None, text), (None, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, map(tuple, simhash.keep_one(docs).collect())))
    assert kept == sorted(map(str, [(5, text), (5, other), (None, text), (None, None), (8, None)]))
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_spanning_forest():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, (2, 400))
    label = np.arange(60)
    label[[5, 9]] = 2
    weight = rng.integers(0, 50, 400)
    chosen = graph.spanning(label, a, b, weight)
    assert (graph.joined(label.copy(), a[chosen], b[chosen]) == graph.joined(label.copy(), a, b)).all()
    assert len(chosen) == len(set(label)) - len(set(graph.joined(label.copy(), a, b)))


def test_parity_bits_never_exceed_the_difference():
    from millrace.llm import shingle_join

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in rng.integers(0, 200, 60)]
    h, at, _ = shingle_join.shingle_sets(texts, 2)
    bits = shingle_join.parity(h, at)
    for i in range(60):
        for j in range(60):
            apart = len(set(h[at[i] : at[i + 1]].tolist()) ^ set(h[at[j] : at[j + 1]].tolist()))
            assert int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= apart


def test_golay_keys_meet_at_two_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64) << np.uint64(1)
    for flips in (0, 1, 2):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, flips, replace=False):
                b[i] ^= np.uint64(1 << int(bit))
        sets = []
        for x in (a, b):
            s = [set() for _ in x]
            for k, i in zip(*simhash.keys(x)):
                s[i].add(int(k))
            sets.append(s)
        assert all(p & q for p, q in zip(*sets))


def test_large_groups_are_linked_alike(monkeypatch):
    rng = np.random.default_rng(4)
    fp = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, 5)) for _ in range(700)], np.uint64))
    small = simhash.linked(fp)
    monkeypatch.setattr(simhash, "BLOCK_GROUP", 10)
    assert (simhash.linked(fp) == small).all()
    assert len(set(small.tolist())) < len(fp)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 4)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def brute_winnow(text, k=winnow.GRAM, w=winnow.WINDOW):
    mask, n = (1 << 64) - 1, len(text)
    if not n:
        return []

    def mixed(x):  # splitmix64
        x = x + 0x9E3779B97F4A7C15 & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def hashed(gram):
        return mixed(sum(mixed(ord(c)) * pow(0xD1342543DE82EF95, i, 1 << 64) for i, c in enumerate(gram)) & mask ^ len(gram) << 40) >> 32

    grams = max(n - k + 1, 1)
    h = [hashed(text[i : i + k]) for i in range(grams)]
    chosen = []
    for s in range(max(grams - w + 1, 1)):
        window = range(s, min(s + w, grams))
        at = max((i for i in window if h[i] == min(h[j] for j in window)))
        if not chosen or chosen[-1] != (h[at], at):
            chosen.append((h[at], at))
    return chosen


def test_op7_equals_brute_force(docs, spark):
    texts = [t or "" for _, t in AWKWARD if len(t or "") < 500] + ["ab" * 60, "a" * 100, "0123456789abcdef", "0123456789abcdefg"]
    hashes, places, at = winnow.winnow(texts)
    for i, t in enumerate(texts):
        assert list(zip(hashes[at[i] : at[i + 1]].tolist(), places[at[i] : at[i + 1]].tolist())) == brute_winnow(t)
    rows = {}
    for r in winnow.compare_edited(docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    ordered = sorted(((i, t or "") for i, t in AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sum(map(len, rows.values())) == len(ordered)

    def like(a, b):
        x, y = {h for h, _ in a}, {h for h, _ in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        match = [r for r in rows[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)]
        assert match
        if len(t) < 1000 and len(u) < 1000:
            assert abs(match[0].near_edited - like(brute_winnow(t), brute_winnow(edited))) < 1e-9
            assert any(abs(m.near_next - like(brute_winnow(t), brute_winnow(u))) < 1e-9 for m in match)
    assert len({r.fingerprint for i in (11, 12) for r in rows[i]}) == 1
    assert winnow.compare_edited(empty(docs)).count() == 0
    single = winnow.compare_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert single.near_next == 1.0


def test_winnowing_keeps_its_promise():
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdef"), winnow.GRAM + winnow.WINDOW - 1))
    texts = ["".join(rng.choice(list("xyz "), int(rng.integers(0, 90)))) + passage + "".join(rng.choice(list("uvw "), 70)) for _ in range(20)]
    hashes, _, at = winnow.winnow(texts)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(at, at[1:])]
    assert all(s & sets[0] for s in sets)


def brute_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_op6_equals_brute_force(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = [thue_morse(n, "ab") + x + thue_morse(n, "ba") + x + thue_morse(n, "ab") for n in (1024, 4096) for x in ("\n", " u v ")]
    extra += ["a b c\nx\na b c\nx\n\n a b c", "p q r p q r p q r " * 9, "one\r\ntwo\r\none\r\n", "## ** <x> |"]
    texts = [t or "" for _, t in AWKWARD] + extra
    counts = quality_rules.text_counts(texts)
    assert list(zip(*(counts[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [brute_counts(t) for t in texts]
    m = quality_rules.Fertility(path).measure(texts)
    for i, t in enumerate(texts):
        ids = model.encode(t)
        share = np.unique(ids, return_counts=True)[1] / max(len(ids), 1)
        assert m["n_tokens"][i] == len(ids) and abs(m["token_entropy"][i] + (share * np.log2(share)).sum()) < 1e-9
        assert abs(m["byte_share"][i] - sum(map(model.is_byte, ids)) / max(len(ids), 1)) < 1e-9
    rows = quality_rules.apply_rules(docs, [path]).collect()
    assert len(rows) == len(AWKWARD) and all(not r.kept for r in rows if r.base_failed)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert quality_rules.apply_rules(empty(docs), [path]).count() == 0
    assert list(quality_rules.SCRIPT_BANDS)[quality_rules.scripts(["привет мир", "日本語", "abc"])[0]] == "cyrillic"


def test_op6_bands_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    paths = [public_tokenizers.path(v) for v in quality_rules.LANGUAGE_BANDS]
    judged = quality_rules.apply_rules(docs, paths).where("not base_failed").join(labels, "doc_id")
    bad, good = (judged.where(f"quality = {q}").select(F.avg(F.col("kept").cast("int"))).first()[0] for q in (0, 1))
    assert bad <= 0.2 and good >= 0.98
    rows = docs.where("lang = 'en'").join(labels.where("quality = 1"), "doc_id").limit(20).collect()
    ridden = [(r.doc_id, "".join(w + ("*** ", "$$$ ")[k % 2] for k, w in enumerate(r.text.split()[:400])), "en") for r in rows]
    assert not any(r.kept for r in quality_rules.apply_rules(spark.createDataFrame(ridden, "doc_id long, text string, lang string"), paths).collect())


def test_op6_has_a_text_for_each_band(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(400)]
    texts = [" ".join(words), " ".join(f"\U00010380{w}" for w in words), " ".join(rng.choice(["the", "and", "water", "people", "little", "house", "from", "about"], 90))]
    path, other = (public_tokenizers.path(v) for v in quality_rules.LANGUAGE_BANDS)
    m = quality_rules.Fertility(path).measure(texts)
    wide = quality_rules.Band(0.0, 99.0, 1.0, 0.0)
    middle = {k: sorted(m[k])[1] for k in ("chars_per_token", "byte_share", "token_entropy")}
    bands = {
        "chars_per_token": wide._replace(least_chars=middle["chars_per_token"]),
        "most": wide._replace(most_chars=middle["chars_per_token"]),
        "byte_share": wide._replace(most_bytes=middle["byte_share"] + 1e-9),
        "token_entropy": wide._replace(least_entropy=middle["token_entropy"]),
    }
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    judge = lambda band: {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, [path], {"piece_bpe_32k.model": {"xx": band}}).collect() if not r.base_failed}
    assert all(judge(wide).values())
    for name, band in bands.items():
        kept = judge(band)
        key = "chars_per_token" if name == "most" else name
        for i, k in kept.items():
            v = m[key][i]
            assert k == (v <= band.most_chars if name == "most" else v <= band.most_bytes if name == "byte_share" else v >= middle[key])
        assert not all(kept.values()), name
        both = {"piece_bpe_32k.model": {"xx": band}, "byte_bpe_50k.json": {"xx": wide}}  # odd in one vocabulary only
        assert all(r.kept for r in quality_rules.apply_rules(docs, [path, other], both).collect() if not r.base_failed)


def test_op5_cascade_is_exact(spark):
    universe = [f"site{i}.example.com" for i in range(3000)] + [None]
    listed = [f"site{i}.example.com" for i in range(0, 3000, 50)] + ["absent.example.com"]
    df = spark.createDataFrame([(u,) for u in universe * 2], "host string")
    for rate in (None, 0.5):
        cascade, seed = url_filter.build(df, "host", listed, rate)
        hashes = df.where("host is not null").select("host", F.xxhash64(F.lit(seed), "host").alias("h")).distinct().collect()
        said = cascade.test(np.array([r.h for r in hashes], np.int64))
        assert {r.host for r, x in zip(hashes, said) if x} == set(listed) & set(universe)
        assert len(cascade.parts[0].levels) > 1 and (rate or cascade.bits < 30 * len(listed))
    many, seed = url_filter.build(df, "host", listed, most=9)
    hashes = df.where("host is not null").select("host", F.xxhash64(F.lit(seed), "host").alias("h")).distinct().collect()
    assert len(many.parts) == 7
    assert {r.host for r, x in zip(hashes, many.test(np.array([r.h for r in hashes], np.int64))) if x} == set(listed) & set(universe)
    nothing, _ = url_filter.build(df, "host", [])
    assert not nothing.test(np.array([1, 2], np.int64)).any()


def test_op5_rules(spark):
    cases = [
        (1, "http://A.com/x", "a.com", "/x", "com/", "allow"),
        (2, "https://b.example.com/en/1?q", "b.example.com", "/en/1", "example.com/en/", "block"),
        (3, "https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (4, "https://x.net/fr/#a", "x.net", "/fr/", "net/fr/", "block"),
        (5, "https://x.net/de/", "x.net", "/de/", None, "allow"),
        (6, "http://m.spam-farm.example.org/de/9", "m.spam-farm.example.org", "/de/9", None, "block"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme.com/", "", "", None, "allow"),
        (9, "http://a.com", "a.com", "", None, "allow"),
        (9, "http://a.com?x=/", "a.com", "", None, "allow"),
        (None, "x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ]
    df = spark.createDataFrame([(*c[:2], "clash") for c in cases], "page_id long, url string, site string")
    assert sorted(map(str, map(tuple, url_filter.judge(df).collect()))) == sorted(str((c[0], *c[2:])) for c in cases)
    assert url_filter.judge(df.limit(0)).count() == 0


def corpus(n, seed=0):
    """Invented text in two languages, with labels: bad texts shout or carry symbols."""
    rng = np.random.default_rng(seed)
    ends = {"aa": ["an", "the", "ing", "er", "on"], "bb": ["ung", "sch", "keit", "der", "ein"]}
    out = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        w = ["".join(rng.choice(ends[lang], rng.integers(1, 4))) for _ in range(int(rng.integers(20, 90)))]
        good = rng.random() < 0.7
        out.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" if i % 3 else x + "***" for x in w), lang, int(good)))
    return out


def test_op8_on_held_out_rows(spark, docs):
    df = spark.createDataFrame([r[:3] for r in corpus(240)] + [(900, "x", None), (901, None, "aa")], "doc_id long, text string, lang string")
    field = language_id.train(df, ~held_out(4))
    rows = {r.doc_id: r for r in language_id.identify(df, field).collect()}
    held = [r for r in corpus(240) if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(rows[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[901].lang_pred == "und"
    mixed = field.label("anther ingon erthe onan " * 5 + "ungsch keitder einung schkeit " * 5)
    assert sum(x == "aa" for _, x in mixed[:20]) >= 18 and sum(x == "bb" for _, x in mixed[20:]) >= 18
    found = {r.doc_id: r for r in language_id.identify(docs, field).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {3, 5, 9}
    kept = language_id.keep_identified(docs, field)
    assert kept.columns == docs.columns and not {3, 5, 9} & {r.doc_id for r in kept.collect()}
    strange = [(1, " ".join(r[1] for r in corpus(6)[1::2]).lower()), (2, "dnia dzisiejszego wszyscy obywatele powinni pójść do urzędu żeby złożyć podpis pod petycją"), (3, "привет мир это простой текст на русском языке который не был изучен")]
    left = language_id.keep_identified(spark.createDataFrame(strange, "doc_id long, text string"), field)
    assert [r.doc_id for r in left.collect()] == [1]  # the others are in languages that were not learned
    none = language_id.train(empty(docs), ~held_out(4))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.keep_identified(docs, none).count() == len(AWKWARD)


def test_forward_backward_equals_enumeration():
    from itertools import product

    field = language_id.Field(["a", "b", "c"], np.zeros((1 << 16, 3)))
    rng = np.random.default_rng(0)
    field.move = rng.normal(size=(3, 3)).astype(np.float32)
    e = rng.normal(size=(7, 3)).astype(np.float32)
    chain, place = np.array([0, 0, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 3, 0, 1, 0])
    post, _ = field.marginals(e, chain, place)
    for k in range(3):
        at = np.flatnonzero(chain == k)
        total, marginal = 0.0, np.zeros((len(at), 3))
        for path in product(range(3), repeat=len(at)):
            p = np.exp(sum(e[i, s] for i, s in zip(at, path)) + sum(field.move[s, t] for s, t in zip(path, path[1:])))
            total += p
            for j, s in enumerate(path):
                marginal[j, s] += p
        assert np.allclose(post[at], marginal / total, atol=1e-4)


def test_a_long_text_is_one_chain():
    rng = np.random.default_rng(4)
    field = language_id.Field(["a", "b", "c"], rng.normal(size=(1 << 16, 3)))
    field.weights = rng.normal(size=field.weights.shape).astype(np.float32)
    field.move = 2 * rng.normal(size=(3, 3)).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcde"), 3)) for _ in range(n)) for n in (700, 1, 64, 65, 128)]
    w = language_id.Words(["", *texts])
    post, e, move = field.posterior(w), np.exp(field.evidence(w).astype(float)), np.exp(field.move.astype(float))
    for k in range(1, 6):
        at = np.flatnonzero(w.owner == k)
        ahead, behind = e[at].copy(), np.ones((len(at), 3))
        for t in range(1, len(at)):
            ahead[t] = ahead[t - 1] @ move * e[at[t]]
            ahead[t] /= ahead[t].sum()
        for t in range(len(at) - 2, -1, -1):
            behind[t] = move @ (e[at[t + 1]] * behind[t + 1])
            behind[t] /= behind[t].sum()
        exact = ahead * behind
        assert np.allclose(post[at], exact / exact.sum(axis=1, keepdims=True), atol=1e-4)


def test_op8_sample_is_never_empty(spark):
    for texts in (1, 1000, 10**9, 10**13):
        share = (language_id.draw_border(300, texts) + (1 << 63)) / (1 << 64)
        assert min(texts, 900) <= share * texts <= min(texts, 1200) + 1
    rows = [(1, f"anther ingon erthe {'x' * (k % 3)}", "aa") for k in range(3000)] + [(None, "ungsch keitder", "bb")] * 500
    field = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert field.predict(["anther erthe", "keitder ungsch"])[0] == ["aa", "bb"]
    clash = spark.createDataFrame([(*r, 0.1, "h") for r in rows[:50]], "doc_id long, text string, lang string, score double, h string")
    assert {r.lang_pred for r in language_id.identify(clash, language_id.train(clash, F.lit(True))).collect()} == {"aa"}


def test_op8_learns_every_language(spark):
    """More languages than are counted or carried over at once: the rarest, each of few texts, are learned as well."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows, held = [], []
    for k in range(150):
        endings = ["".join(rng.choice(letters, 4)) for _ in range(6)]
        texts = [" ".join("".join(rng.choice(endings, 2)) for _ in range(30)) for _ in range(6 if k < 100 else 4)]
        rows += [(None, x, f"l{k:03}") for x in texts[1:]]
        held.append((k, texts[0], f"l{k:03}"))
    field = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert field.names == [r[2] for r in held]
    found = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), field).collect()}
    assert sum(found[k] == lang for k, _, lang in held) >= 0.97 * len(held)
    kept = language_id.keep_identified(spark.createDataFrame(held, "doc_id long, text string, lang string"), field)
    assert kept.count() >= 0.97 * len(held)
    mixed = field.label(f"{held[140][1]} {held[3][1]}")
    assert sum(x == "l140" for _, x in mixed[:30]) >= 28 and sum(x == "l003" for _, x in mixed[30:]) >= 28


def test_texts_of_many_languages_are_one_chain(monkeypatch):
    """Step by step, in spans of few words, forward-backward gives what whole chains give, and matrices of blocks."""
    rng = np.random.default_rng(6)
    field = language_id.Field([str(i) for i in range(70)], rng.normal(size=(1 << 16, 70)))
    field.weights = rng.normal(size=field.weights.shape).astype(np.float32) / 2
    field.move = 2 * rng.normal(size=(70, 70)).astype(np.float32)
    texts = ["", *(" ".join("".join(rng.choice(list("abcde"), 3)) for _ in range(n)) for n in (300, 1, 64, 65, 128)), "", "a" * 500]
    w = language_id.Words(texts)
    whole, shares = field.posterior(w), field.predict(texts)
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 70)
    assert np.allclose(field.posterior(w), whole, atol=1e-4)
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 64)
    for held in (70, 70 * 40, 70 * 1000):
        monkeypatch.setattr(language_id, "HELD_VALUES", held)
        assert np.allclose(field.posterior(w), whole, atol=1e-4)
        names, share = field.predict(texts)
        assert names == shares[0] and np.allclose(share, shares[1], atol=1e-4)


def test_op8_fits_on_the_start_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 400)
    rows = [(i, x[1] * 40, x[2]) for i, x in enumerate(corpus(40, 2))]  # all are longer
    field = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert np.abs(field.weights).max() > 0.01
    assert language_id._stretches("ab, cd! " * 70 + "e") == [("ab, cd! " * 32)[:-2], ("ab, cd! " * 32)[:-2], ("ab, cd! " * 6) + "e"]


def test_op1_on_held_out_rows(spark, docs):
    rows = corpus(600, 1)
    df = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows] + [(None, 1, 0), (1, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(df, labels, ~held_out(4))
    scores = {r.doc_id: r.score for r in quality_classifier.score(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum((scores[r[0]] >= 0.7) == bool(r[3]) for r in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 602
    assert 0.2 <= model.network.temperature <= 8
    assert quality_classifier.score(docs, model).count() == len(AWKWARD)
    kept = quality_classifier.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() < 602
    unknown = quality_classifier.train(empty(docs), labels.limit(0), F.lit(True))
    assert {r.score for r in quality_classifier.score(docs, unknown).collect()} == {0.5}
    assert quality_classifier.keep_good(docs, unknown).count() == len(AWKWARD)


def test_word_vectors_are_sums_of_contexts():
    texts = ["a b c a", "b"]
    word, owner = quality_classifier.buckets(texts)
    place, sign = quality_classifier.index_vectors()
    expected = np.zeros((quality_classifier.BUCKETS, quality_classifier.WIDTH))
    for i, w in enumerate(word):
        for j in range(max(0, i - 2), min(len(word), i + 3)):
            if i != j and owner[i] == owner[j]:
                np.add.at(expected[w], place[word[j]], sign[word[j]])
    assert np.allclose(quality_classifier.context_sums(texts).reshape(expected.shape), expected)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 1), (1, 5), (1000, 1 << 20), (2000, 1 << 50), (3000, 100)):
        v = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        e = EliasFano(mapped(EliasFano.encode(v, universe)))
        q = np.concatenate([rng.integers(0, universe + 3, 500).astype(np.uint64), v])
        assert (e.successor(q) == np.searchsorted(v, q)).all()
        assert not n or (e[np.arange(n)] == v).all()
        low = rng.integers(0, n + 1, len(q))
        high = low + rng.integers(0, n + 1 - low)
        assert e.successor(q, low, high).tolist() == [a + int(np.searchsorted(v[a:b], x)) for x, a, b in zip(q, low, high)]
    pair = np.unique(rng.integers(0, 1 << 28, 3000)).astype(np.uint64)
    code = rng.integers(1, 256, len(pair))
    known = dict(zip(pair.tolist(), code.tolist()))
    for bits in (20, 26):  # many contexts with few successors, few with many
        b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
        trie = Trie(mapped(Trie.encode(pair >> b, pair & low, code, bits)))
        q = np.concatenate([pair, rng.integers(0, 1 << 28, 3000).astype(np.uint64)])
        for asked in (q, np.unique(np.concatenate([q, rng.integers(0, 1 << 28, 30_000).astype(np.uint64)]))):
            assert trie.lookup(asked >> b, asked & low).tolist() == [known.get(x, 0) for x in asked.tolist()]
        assert (trie.words.stretch(100, 1700) == trie.words[np.arange(100, 1700)]).all()


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for keys in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.unique(rng.integers(0, 1 << 63, 900)).astype(np.uint64) * np.uint64(2)):
        assert (ngram_lm.unpack_sorted(ngram_lm.pack_sorted(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (ngram_lm.unpack_counts(ngram_lm.pack_counts(counts)) == counts).all()
    for runs in (counts[:0], np.repeat(counts, [3, 1, 700, 2, 1, 9])):
        assert (ngram_lm.unpack_runs(ngram_lm.pack_runs(runs)) == runs).all()


def test_op4_equals_brute_force(spark, docs):
    rows = [(r[0], r[1]) for r in corpus(150, 2)] + [(i, t) for i, t in AWKWARD]
    rows = [(1000 + k if i is None else i if k < 150 else 500 + k, t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score(df, ~held_out(7)).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    count, pair, texts = {}, {}, 0
    for i, t in rows:
        if i not in held:
            texts += 1
            w = [*words_of(t), None]
            for a, b in zip([0, *w], w):
                count[b] = count.get(b, 0) + 1
                pair[a, b] = pair.get((a, b), 0) + 1
    n, v = sum(count.values()), len(count)
    before = count | {0: texts}
    for i, t in rows:
        w = [*words_of(t), None]
        base = sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip([0, *w], w):
            alone = (count.get(b, 0) + 1) / (n + v + 1)
            score += np.log10(0.5 * pair.get((a, b), 0) / before[a] + 0.5 * alone if before.get(a) else alone)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * len(w) and abs(r.score - score) < 0.01 * len(w)
    long = spark.createDataFrame([(1, "a b " * 200_000), (2, "b a")], "doc_id long, text string")
    assert {r.n_tokens for r in ngram_lm.score(long, F.lit(True)).collect()} == {400_001, 3}
    awkward = ngram_lm.score(docs, ~held_out(7)).collect()
    assert len(awkward) == len(AWKWARD) and ngram_lm.score(empty(docs), F.lit(True)).count() == 0
    untrained = ngram_lm.score(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}


def test_chunks_keep_rows_and_order(docs):
    table = docs.select("doc_id", "text").toArrow()
    out = [(i, t) for rows, texts in chunks(table.to_batches(), size=50) for i, t in zip(rows.column("doc_id").to_pylist(), texts)]
    assert out == [(i, t or "") for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())]
