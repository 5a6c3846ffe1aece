"""URL columns: a canonical form, the support of an answer by cited URLs, and a catalogue of damages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.hashing import draw, json_string, stable_seed
from millrace.functions.text import jaccard, let, letters, strip

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_WRAP = r"[`\"'<>\[\](){}.,;:!?*_ ]+"


def unquote(text: Column) -> Column:
    """Percent-decoded; a stray % stays and + is no space."""
    whole = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), text)


def quote(text: Column) -> Column:
    """Percent-encoded but for letters, digits and ``_.-~``."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parts(url: Column) -> Column:
    """A struct of the pieces of a URL in canonical form; valid is false where it can't be parsed."""

    def cut(full: Column) -> Column:
        group = lambda k: F.regexp_extract(full, _PARTS, k)
        after = lambda x: x.substr(F.lit(2), F.length(x))
        return F.struct(F.lower(group(1)).alias("scheme"), F.regexp_replace(group(2), "^.*@", "").alias("netloc"), group(3).alias("path"), after(group(4)).alias("query"), after(group(5)).alias("fragment"))

    def made(r: Column, bare: Column) -> Column:
        scheme, netloc = r["scheme"], r["netloc"]
        port = F.regexp_extract(netloc, r":(\d*)$", 1)
        host = F.lower(F.regexp_replace(netloc, r":\d*$", ""))
        usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        shown = F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), F.regexp_replace(port, "^0+(?=.)", "")))
        path = F.regexp_replace(unquote(r["path"]), "/{2,}", "/")
        coded = lambda x: quote(unquote(F.replace(x, F.lit("+"), F.lit(" "))))
        pair = lambda p: F.struct(coded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), coded(p.substr(F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v"))
        pairs = F.array_sort(F.transform(F.filter(F.split(r["query"], "&"), lambda p: p != ""), pair))
        query = F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
        valid = (scheme != "") & ~F.contains(host, F.lit(":"))
        return F.struct(valid.alias("valid"), scheme.alias("scheme"), F.concat(host, shown).alias("netloc"), F.when(path == "", "/").otherwise(path).alias("path"), query.alias("query"), unquote(r["fragment"]).alias("fragment"), bare.alias("bare"))

    def parsed(bare: Column) -> Column:
        full = F.when(F.contains(bare, F.lit("://")), bare).otherwise(F.concat(F.lit("https://"), F.ltrim(bare, F.lit("/"))))
        return let(let(full, cut), lambda r: made(r, bare))

    return let(F.regexp_replace(strip(url), f"^{_WRAP}|{_WRAP}$", ""), parsed)


def _rebuilt(p: Column, whole: bool) -> Column:
    location = F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"])
    if not whole:
        return location
    return F.concat(location, F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])), F.when(p["fragment"] == "", "").otherwise(F.concat(F.lit("#"), p["fragment"])))


def _whole(p: Column) -> Column:
    """The canonical form of parsed parts; of what can't be parsed, the decoded text in lower case."""
    return F.when(p["valid"], _rebuilt(p, True)).otherwise(F.lower(strip(unquote(p["bare"]))))


def forms(url: Column) -> Column:
    """A struct of location (scheme, host and path), whole and query of the canonical form; all empty for an empty URL."""

    def made(p: Column) -> Column:
        loose = F.lower(strip(unquote(p["bare"])))
        return F.struct(F.when(p["valid"], _rebuilt(p, False)).otherwise(loose).alias("location"), F.when(p["valid"], _rebuilt(p, True)).otherwise(loose).alias("whole"), F.coalesce(p["query"], F.lit("")).alias("query"))

    empty = F.struct(F.lit("").alias("location"), F.lit("").alias("whole"), F.lit("").alias("query"))
    return F.when(F.coalesce(strip(url) == "", F.lit(True)), empty).otherwise(let(parts(url), made))


def normalize(url: Column) -> Column:
    """The canonical form: folds case of scheme and host, the default port, encoding and the order of parameters only."""
    return forms(url)["whole"]


def location_of(url: Column) -> Column:
    """Scheme, host and path of the canonical form."""
    return forms(url)["location"]


def query_of(url: Column) -> Column:
    return forms(url)["query"]


def is_correct(predicted: Column, gold: Column) -> Column:
    """Equal in canonical form; an empty prediction never is. With the damaged URL as gold: an echo."""
    return F.coalesce(predicted != "", F.lit(False)) & let(F.transform(F.array(predicted, gold), forms), lambda f: f[0]["whole"] == f[1]["whole"])


def support_of(predicted: Column, own: Column, others: Column, variant: Column) -> Column:
    """Why cited URLs support an answer (``supported``) or don't, from the forms of both."""
    has = lambda k: F.exists(others, lambda o: o[k] == own[k])
    return (
        F.when(F.coalesce(predicted == "", F.lit(True)), "no_answer")
        .when(F.coalesce(F.size(others) < 1, F.lit(True)), "nothing_cited")
        .when(own["location"] == "", "unparseable_answer")
        .when(~has("location"), "location_not_cited")
        .when(variant.isin("pick", "pick_hard") & ~has("whole"), "answer_not_a_cited_candidate")
        .when((variant == "compose") & (own["query"] != "") & ~has("query"), "query_not_cited")
        .otherwise("supported")
    )


def support(predicted: Column, cited: Column, variant: Column) -> Column:
    """Why the cited URLs support an answer (``supported``) or don't."""
    every = F.transform(F.concat(F.array(predicted), F.coalesce(cited, F.array().cast("array<string>"))), forms)
    return let(every, lambda f: support_of(predicted, F.get(f, 0), F.slice(f, F.lit(2), F.greatest(F.size(f), F.lit(1))), variant))


def compose(base: Column, donor: Column) -> Column:
    """The location of one URL with the query of another."""
    return F.concat(location_of(base), F.lit("?"), let(query_of(donor), lambda q: F.when(q == "", "ref=combined").otherwise(q)))


def relevance(damaged: Column, candidate: Column) -> Column:
    """How like a candidate is to a damaged URL, both in canonical form: host, path words, parameter names and length."""
    return let(parts(damaged), lambda a: relevance_of(a, candidate))


def relevance_of(damaged: Column, candidate: Column) -> Column:
    """The same, of the damaged URL's parts."""
    words = lambda p: F.array_distinct(F.regexp_extract_all(p["path"], F.lit("[a-z0-9]+"), F.lit(0)))
    names = lambda p: F.array_distinct(F.filter(F.transform(F.split(p["query"], "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != ""))
    size = lambda p: F.length(_whole(p))

    def score(a: Column, b: Column) -> Column:
        near = (60 - F.least(F.abs(size(a) - size(b)), F.lit(60))) / 60
        host = F.when((a["netloc"] == b["netloc"]) & (a["netloc"] != ""), 2.0).otherwise(0.4 * jaccard(letters(a["netloc"]), letters(b["netloc"])))
        return host + 1.5 * jaccard(words(a), words(b)) + 1.2 * jaccard(names(a), names(b)) + 0.5 * near

    return let(parts(candidate), lambda b: score(damaged, b))


def _pick(seed: Column, salt: str, *options: Column) -> Column:
    return F.get(F.array(*options), (draw(seed, salt) % len(options)).cast("int"))


def _after_scheme(url: Column, change: Callable[[Column], Column]) -> Column:
    """Changes the path, with its host, between the scheme and the query."""
    head = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    rest = url.substr(F.length(head) + 1, F.length(url))
    tail = F.regexp_extract(rest, r"(?s)(\?.*)$", 1)
    return F.concat(head, F.array_join(change(F.split(F.substring_index(rest, "?", 1), "/")), "/"), tail)


def _drop_segment(url: Column, seed: Column) -> Column:
    def change(p: Column) -> Column:
        at = 2 + (draw(seed, "segment") % F.greatest(F.size(p) - 2, F.lit(1))).cast("int")
        return F.when(F.size(p) > 3, F.filter(p, lambda x, i: i != at)).otherwise(p)

    return _after_scheme(url, change)


def _repeat_segment(url: Column, seed: Column) -> Column:
    def change(p: Column) -> Column:
        own = F.filter(p, lambda x: x != "")
        at = 2 + (draw(seed, "segment") % F.greatest(F.size(own) - 2, F.lit(1))).cast("int")
        longer = F.concat(F.array(F.lit("")), F.slice(own, F.lit(1), at), F.slice(own, 2, 1), F.slice(own, at + 1, F.size(own)))
        return F.when(F.size(own) > 2, longer).otherwise(p)

    return _after_scheme(url, change)


def _reorder(url: Column, seed: Column) -> Column:
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    pairs = F.split(query, "&")
    mixed = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda p, i: F.struct(stable_seed(seed.cast("string"), "order", i.cast("string")).alias("o"), p.alias("p")))), lambda x: x["p"]), "&")
    return F.when(F.size(pairs) > 1, F.concat(F.substring_index(url, "?", 1), F.lit("?"), mixed, F.regexp_extract(url, r"(?s)(#.*)$", 1))).otherwise(url)


def _truncate(url: Column, seed: Column) -> Column:
    low = F.greatest(F.floor(F.length(url) / 2), F.lit(12))
    high = F.greatest(F.length(url) - 2, F.lit(13))
    return url.substr(F.lit(1), (low + draw(seed, "cut") % F.greatest(high - low + 1, F.lit(1))).cast("int"))


def _first(url: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(url, f"(?s)^(.*?){pattern}", f"$1{to}")


def _spaced_slash(url: Column, seed: Column) -> Column:
    return F.when(F.contains(url.substr(F.lit(9), F.length(url)), F.lit("/")), _first(url, "/", " / ")).otherwise(url)


_cut_fragment = lambda u, s: F.substring_index(u, "#", 1)

#: name: (damage of (url, seed), difficulty 1 to 3).
CORRUPTIONS: dict[str, tuple[Callable[[Column, Column], Column], int]] = {
    "drop_scheme": (lambda u, s: F.regexp_replace(u, "(?i)^[a-z]+://", ""), 1),
    "drop_www": (lambda u, s: _first(u, "(?i)://www\\.", "://"), 1),
    "sentence_punctuation": (lambda u, s: F.concat(u, _pick(s, "mark", *map(F.lit, ".,!?;:"))), 1),
    "markdown_wrapper": (lambda u, s: _pick(s, "wrap", F.concat(F.lit("`"), u, F.lit("`")), F.concat(F.lit("<"), u, F.lit(">")), F.concat(F.lit("["), u, F.lit("]")), F.concat(u, F.lit(".")), F.concat(F.lit('"'), u, F.lit('"'))), 1),
    "whitespace": (_spaced_slash, 1),
    "newlines": (_spaced_slash, 1),
    "http_typo": (lambda u, s: F.when(u.startswith("https://"), F.regexp_replace(u, "^https://", "htps://")).otherwise(_first(u, "http://", "https:/")), 2),
    "uppercase_host": (lambda u, s: F.concat(F.regexp_extract(u, "(?s)^(.*?://)", 1), F.upper(F.regexp_extract(u, "(?s)^.*?://([^/?#]*)", 1)), F.regexp_replace(u, "(?s)^.*?://[^/?#]*", "")), 2),
    "double_slash": (_repeat_segment, 2),
    "reorder_query": (_reorder, 2),
    "drop_fragment": (_cut_fragment, 2),
    "fragment_moved": (lambda u, s: F.regexp_replace(u, r"(?s)^([^#?]*)(\?[^#]*)(#.*)$", "$1$3$2"), 2),
    "drop_port": (lambda u, s: F.regexp_replace(u, r"(://[^/:]+):\d+", "$1"), 2),
    "strip_percent_encoding": (lambda u, s: unquote(u), 2),
    "double_encode": (lambda u, s: F.replace(u, F.lit("&"), F.lit("&amp;")), 3),
    "html_entities": (lambda u, s: F.replace(F.replace(u, F.lit("/"), F.lit("&#x2F;")), F.lit("?"), F.lit("&quest;")), 3),
    "unicode_host": (lambda u, s: _first(u, r"\.([a-z]{2,4})(?=[/:?#]|$)", ".ünicode$2"), 3),
    "drop_path_segment": (_drop_segment, 3),
    "truncate": (_truncate, 3),
    "truncate_tail": (lambda u, s: F.when(F.contains(u, F.lit("?")), F.substring_index(u, "?", 1)).otherwise(F.substring_index(u, "#", 1)), 2),
    "lose_fragment": (_cut_fragment, 2),
}
# Damages after which the query can still be read.
QUERY_PRESERVING = ("drop_scheme", "drop_www", "sentence_punctuation", "markdown_wrapper", "whitespace", "newlines", "http_typo", "uppercase_host", "double_slash", "reorder_query", "drop_fragment", "fragment_moved", "double_encode", "html_entities", "lose_fragment")


def difficulty(kinds: Column) -> Column:
    """Of a list of damages: that of the hardest (1 for none)."""
    table = F.create_map(*[F.lit(x) for name, (_, hard) in CORRUPTIONS.items() for x in (name, hard)])
    return F.coalesce(F.array_max(F.transform(kinds, lambda k: table[k])), F.lit(1))


def sample_kinds(seed: Column, names: tuple[str, ...], most: int = 3) -> Column:
    """One to ``most`` of the names without repetition."""
    order = F.array_sort(F.transform(F.array(*map(F.lit, names)), lambda k: F.struct(stable_seed(seed.cast("string"), "kind", json_string(k)).alias("o"), k.alias("k"))))
    return F.slice(F.transform(order, lambda x: x["k"]), F.lit(1), (1 + draw(seed, "kinds") % most).cast("int"))


def corrupt(url: Column, kinds: Column, seed: Column) -> Column:
    """The URL after the named damages in order."""

    def step(u: Column, kind: Column) -> Column:
        out = F.when(F.lit(False), u)
        for name, (damage, _) in CORRUPTIONS.items():
            out = out.when(kind == name, damage(u, seed))
        return out.otherwise(u)

    return F.aggregate(kinds, url, step)


# What synthetic URLs are made of.
SCHEMES = ("https", "http")
DOMAINS = ("com", "org", "net", "io", "dev", "co", "ai", "app", "edu", "gov")
SUBDOMAINS = ("www", "docs", "blog", "api", "cdn", "static", "mail", "shop", "status")
STEMS = (
    "atlas meridian northwind lumen quarry beacon cobalt delta ember fathom granite harbor indigo juniper kestrel lantern "
    "monsoon nimbus orchard pinnacle quartz ridge summit tundra umber vertex willow xenon yarrow zephyr basalt cinder"
).split()
PATH_WORDS = (
    "docs guide pricing blog 2024 2025 release notes api v1 v2 reference tutorial changelog about careers legal privacy "
    "terms status download install setup config faq"
).split()
QUERY_KEYS = ("utm_source", "utm_medium", "utm_campaign", "id", "ref", "page", "q", "lang")
QUERY_VALUES = ("newsletter", "email", "twitter", "docs", "2", "7", "en", "en-GB", "summary")
FRAGMENTS = ("intro", "installation", "faq", "usage", "examples", "top")
PORTS = (":8000", ":8080", ":3000", ":5000")


def make_parts(seed: Column) -> Column:
    """A struct of scheme, host, port, path, query (with its ``?``, or empty) and fragment (with its ``#``) for a seed."""
    chance = lambda salt, pct: draw(seed, salt) % 100 < pct
    pick = lambda salt, options: _pick(seed, salt, *map(F.lit, options))
    host = F.concat_ws(".", F.when(~chance("bare", 15), pick("sub", SUBDOMAINS)), pick("stem", STEMS), pick("domain", DOMAINS))
    depth = (1 + draw(seed, "depth") % 3).cast("int")
    path = F.concat(F.lit("/"), F.array_join(F.slice(F.array(*[pick(f"path{i}", PATH_WORDS) for i in range(3)]), F.lit(1), depth), "/"))
    tail = F.when(chance("tail", 25), F.concat(F.lit("/"), F.lower(F.hex(4096 + draw(seed, "code") % 61440)))).otherwise("")
    pair = lambda i: F.concat(pick(f"key{i}", QUERY_KEYS), F.lit("="), pick(f"value{i}", QUERY_VALUES))
    pairs = F.array_sort(F.slice(F.array(pair(0), pair(1), pair(2)), F.lit(1), (1 + draw(seed, "pairs") % 3).cast("int")))
    return F.struct(
        pick("scheme", SCHEMES).alias("scheme"),
        host.alias("host"),
        F.when(chance("port", 15), pick("which", PORTS)).otherwise("").alias("port"),
        F.concat(path, tail).alias("path"),
        F.when(chance("query", 55), F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("").alias("query"),
        F.when(chance("fragment", 30), F.concat(F.lit("#"), pick("name", FRAGMENTS))).otherwise("").alias("fragment"),
    )


def joined(p: Column) -> Column:
    """The URL of a struct of parts."""
    return F.concat(p["scheme"], F.lit("://"), p["host"], p["port"], p["path"], p["query"], p["fragment"])


def make_url(seed: Column) -> Column:
    """A synthetic canonical URL for a seed."""
    return let(make_parts(seed), joined)


def landed(url: Column, kinds: Column) -> Column:
    """Of a list of damages, those that alone change the URL (with draws of their own that are always the same)."""
    zero = F.lit(0).cast("long")

    def changes(kind: Column) -> Column:
        out = F.lit(False)
        for name, (damage, _) in CORRUPTIONS.items():
            out = F.when(kind == name, damage(url, zero) != url).otherwise(out)
        return out

    return F.filter(kinds, changes)
