import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import claims, text, urls
from millrace.functions.hashing import content_id, json_string, split_of, stable_seed


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_hashes_are_those_of_hashlib(spark):
    s = 'a "quoted" é\nline'
    digest = hashlib.sha256(json.dumps(["salt", s, 7], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, stable_seed("salt", json_string(F.col("s")), 7), s=s) == int(digest[:16], 16) >> 1
    assert one(spark, content_id(F.col("s")), s=s) == "sha256:" + hashlib.sha256(s.encode()).hexdigest()


def test_split_is_stable_and_in_proportion(spark):
    ids = spark.range(2000).select(F.concat(F.lit("t"), "id").alias("t"))
    rows = ids.select("t", split_of(F.col("t"), "a").alias("s"), split_of(F.col("t"), "b").alias("r")).collect()
    assert 0.74 < sum(r.s == "train" for r in rows) / 2000 < 0.86
    assert any(r.s != r.r for r in rows)
    expected = "eval" if int(hashlib.sha256(f"{rows[5].t}|a".encode()).hexdigest()[:8], 16) % 100 < 20 else "train"
    assert rows[5].s == expected


@pytest.mark.parametrize(
    "s, units",
    [("one, two and three; four: five", ["one,", "two", "three;", "five"]), ("alone", ["alone"]), ("  ", [""]), ("a, b", ["a,", "b"])],
)
def test_units(spark, s, units):
    assert one(spark, text.split_units(F.col("s")), s=s) == units


@pytest.mark.parametrize(
    "turn, free, answer, cite, error",
    [
        ("ok\nCITE: 1, [2]; x\nANSWER: Entailed.", False, "entailed", [1, 2], None),
        ("ANSWER: entailed\nCITE: 0\nANSWER: not_entailed", False, "not_entailed", [0], None),
        ("CITE:\nANSWER: entailed", False, "entailed", [], "empty_CITE"),
        ("ANSWER: entailed", False, "entailed", [], "missing_CITE_line"),
        ("CITE: 1", False, None, [1], "missing_ANSWER_line"),
        ("CITE: 1\nANSWER: maybe", False, "maybe", [1], "unknown_label:maybe"),
        ("CITE: 1\nANSWER: https://A.b/C", True, "https://A.b/C", [1], None),
        ("   ", False, None, [], "empty_assistant_turn"),
        (None, False, None, [], "empty_assistant_turn"),
    ],
)
def test_parse_turn(spark, turn, free, answer, cite, error):
    p = one(spark, text.parse_turn(F.col("s"), free), s=turn)
    assert (p.answer, p.cite, p.error) == (answer, cite, error)


def test_lookups_keep_signs_and_case(spark):
    assert one(spark, text.parse_turn(F.col("s")), s="lookup(1) lookup( -2 ) Lookup(3)").lookups == [1, -2]


@pytest.mark.parametrize(
    "url, normal",
    [
        ("HTTP://Example.COM:80/a//b", "http://example.com/a/b"),
        ("https://x.org:8443", "https://x.org:8443/"),
        ("x.org/p?b=2&a=1", "https://x.org/p?a=1&b=2"),
        ("<https://x.org/p>.", "https://x.org/p"),
        ("https://x.org/a%20b?q=a+b&e=", "https://x.org/a b?e=&q=a%20b"),
        ("https://x.org/50%?x=%7E", "https://x.org/50%?x=~"),
        ("https://x.org/p/#Top", "https://x.org/p/#Top"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize(spark, url, normal):
    assert one(spark, urls.normalize(F.col("u")), u=url) == normal


def test_support_ladder(spark):
    u = "https://x.org/p?a=1"
    why = lambda answer, cited, variant: one(spark, urls.support(F.col("a"), F.split("c", "\\|"), F.lit(variant)), a=answer, c=cited)
    assert why(None, u, "pick") == "no_answer"
    assert why("https://y.org/", u, "pick") == "location_not_cited"
    assert why("https://x.org/p?a=2", u, "pick") == "answer_not_a_cited_candidate"
    assert why("https://x.org/p?a=2", u, "compose") == "query_not_cited"
    assert why("https://x.org/p?b=2", u + "|https://z.org/?b=2", "compose") == "supported"
    assert why(u, u, "pick") == "supported"


@pytest.mark.parametrize(
    "name, url, out",
    [
        ("drop_scheme", "https://www.a.com/b", "www.a.com/b"),
        ("drop_www", "https://www.a.com/b", "https://a.com/b"),
        ("newlines", "https://a.com/?x=1&y=2", "https: / /a.com/?x=1&y=2"),
        ("http_typo", "http://a.com/", "https:/a.com/"),
        ("uppercase_host", "https://a.com/b", "https://A.COM/b"),
        ("fragment_moved", "https://a.com/?x=1#f", "https://a.com/#f?x=1"),
        ("drop_port", "https://a.com:80/b", "https://a.com/b"),
        ("unicode_host", "https://a.com/b", "https://a.ünicodecom/b"),
        ("truncate_tail", "https://a.com/b?x=1#f", "https://a.com/b"),
        ("whitespace", "https://a.com/b", "https: / /a.com/b"),
        ("drop_path_segment", "https://a.com/b", "https://a.com/b"),
    ],
)
def test_damages(spark, name, url, out):
    assert one(spark, urls.CORRUPTIONS[name][0](F.col("u"), F.lit(3)), u=url) == out


def test_damages_with_draws(spark):
    u = "https://docs.atlas.org/a/b/c?x=1&y=2&z=3"
    made = {n: one(spark, urls.CORRUPTIONS[n][0](F.col("u"), F.lit(11)), u=u) for n in ("truncate", "drop_path_segment", "double_slash", "reorder_query", "sentence_punctuation", "markdown_wrapper")}
    assert len(made["truncate"]) in range(len(u) // 2, len(u) - 1) and u.startswith(made["truncate"])
    assert made["drop_path_segment"].count("/") == u.count("/") - 1
    assert made["double_slash"].startswith("https:///docs.atlas.org/")
    assert sorted(made["reorder_query"].split("?")[1].split("&")) == ["x=1", "y=2", "z=3"]
    assert made["sentence_punctuation"][:-1] == u and u in made["markdown_wrapper"]


def test_claims(spark):
    fact = "The bench paid Rs. 1,000."
    assert one(spark, claims.negation(F.col("f")), f=fact) == "It is not the case that the bench paid Rs. 1,000."
    s = one(spark, claims.entity_swap(F.col("f")), f=fact)
    assert (s.claim, s.applied) == ("The bench paid Rs. 26,000.", "entity_swap")
    s = one(spark, claims.entity_swap(F.col("f")), f="Nothing here")
    assert s.applied == "negation"
    ranked = one(spark, claims.rank_facts(F.split("f", "\\|"), F.lit("alpha beta gamma")), f="zeta|alpha beta|alpha|alpha beta gamma")
    assert ranked == ["alpha beta", "alpha", "alpha beta gamma", "zeta"]


def test_completion_is_cleaned(spark):
    assert one(spark, text.clean_completion(F.col("s")), s="<think>a\nb</think>assistant:\nhello <think>x") == "hello"


@pytest.mark.parametrize("turn, done", [("lookup(1)", True), ("CITE: 1\nANSWER: entailed", True), ("ANSWER: entailed", False), ("thinking", False), (None, False)])
def test_turn_complete(spark, turn, done):
    assert one(spark, text.turn_complete(F.col("s")), s=turn) is done
