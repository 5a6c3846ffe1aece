"""URL filter: prefix rules first, then a Bloom filter cascade over the sites of the corpus.

The cascade's first level is a Bloom filter of the listed keys. Keys of the corpus that are not listed but pass it go
into the second level, listed keys that pass that into the third, and so on until none is left over. As every key that
will be asked is in the universe that the cascade was made over, its answer is exact, and no join is needed.

The first level's rate is chosen so that about as many unlisted keys pass as there are listed ones; further levels take
half of what is before them. So the cascade's size follows the listed keys and, by its logarithm, the universe. The
keys that pass level one are counted before they are gathered at the driver; if there are more than expected, level one
is made larger. Listed keys are a parameter; of more than MOST_LISTED, each part by key hash has a cascade of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import mix64

#: (action, host, path): the rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Sites whose pages are not wanted: each name under every domain that the pages have it with.
LISTED_NAMES = ("ads-track.example", "free-bets.example", "cheap-pills.example", "spam-farm.example", "casino-win.example", "adult-x.example")
LISTED_SITES = tuple(f"{name}.{domain}" for name in LISTED_NAMES for domain in ("com", "net", "org"))
#: Listed keys in one cascade: its levels are then under 64 MB.
MOST_LISTED = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def site(host: Column, labels: int = 3) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


class BloomLevel:
    """A Bloom filter over 64-bit key hashes."""

    def __init__(self, keys: np.ndarray, rate: float, salt: int):
        self.salt = salt
        per_key = max(1.0, -math.log(rate) / math.log(2) ** 2)
        self.hashes = max(1, round(per_key * math.log(2)))
        self.size = max(64, math.ceil(per_key * len(keys)))
        self.bits = np.zeros(-(-self.size // 8), np.uint8)
        for at in self._at(keys):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _at(self, keys: np.ndarray) -> Iterable[np.ndarray]:
        a = mix64(keys.astype(np.uint64) ^ np.uint64(self.salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        b = mix64(a) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(self.hashes):
                yield ((a + np.uint64(i) * b) % np.uint64(self.size)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], np.int64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


class Cascade:
    """Exact membership of the keys of a universe: 64-bit hashes in, booleans out."""

    def __init__(self, listed: np.ndarray, first: BloomLevel | None, passing: np.ndarray):
        """passing: hashes of the universe's unlisted keys that pass the first level."""
        self.levels = [first] if first else []
        inside, against = listed, passing
        while self.levels and len(against):
            inside, against = against, inside
            level = BloomLevel(inside, 0.5, len(self.levels) + 1)
            self.levels.append(level)
            against = against[level.test(against)]

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        on = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            on = on[level.test(keys[on])]
            out[on] = i % 2 == 0
        return out

    @property
    def bits(self) -> int:
        return sum(x.size for x in self.levels)


class Cascades:
    """Cascades of the parts of a long list, by key hash."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    def test(self, keys: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.parts[0].test(keys)
        out, part = np.zeros(len(keys), bool), keys % len(self.parts)
        for i, cascade in enumerate(self.parts):
            own = np.flatnonzero(part == i)
            out[own] = cascade.test(keys[own])
        return out

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.parts)


def build(universe: DataFrame, key: str, listed: Iterable[str], rate: float | None = None, most: int = MOST_LISTED) -> tuple[Cascades, int]:
    """Cascades of the listed keys over all keys of the universe (nulls are no keys), and the seed of their hash.

    Listed keys that the universe has not do no harm. A list of more than ``most`` keys is dealt by hash into parts with
    a cascade each. If two different keys had equal hashes and only one were listed, another seed is taken.
    """
    names = sorted(set(listed))
    if not names:
        return Cascades([Cascade(np.zeros(0, np.int64), None, np.zeros(0, np.int64))]), 0
    spark = universe.sparkSession
    keys = universe.select(F.col(key).alias("key")).where("key is not null").distinct()
    named = spark.createDataFrame([(n,) for n in names], "key string")
    parts = -(-len(names) // most)
    total = keys.count()
    seed = 0
    while True:
        hashed = lambda df, i: df.select("key", F.xxhash64(F.lit(seed), "key").alias("h")).where(F.pmod("h", F.lit(parts)) == i)  # noqa: B023, E731
        cascades = [_cascade(hashed(keys, i), hashed(named, i), total // parts, rate) for i in range(parts)]
        if all(cascades):
            return Cascades(cascades), seed
        seed += 1


def _cascade(keys: DataFrame, named: DataFrame, total: int, rate: float | None) -> Cascade | None:
    """The cascade of the listed keys over all keys (key, h); nothing, if a listed and another key have one hash."""
    inside = np.array([r.h for r in named.select("h").collect()], np.int64)
    if not len(inside):
        return Cascade(inside, None, inside)
    p = rate or min(0.5, math.sqrt(0.5) * len(inside) / max(total, 1))
    expected = 64 + 4 * max(len(inside), p * total)
    while True:
        first = BloomLevel(inside, p, 1)
        passes = F.pandas_udf(lambda h, level=first: pd.Series(level.test(h.to_numpy())), "boolean")
        over = keys.where(passes("h")).join(F.broadcast(named), "key", "left_anti").select("h").limit(int(expected) + 1)
        found = np.array([r.h for r in over.collect()], np.int64)
        if len(found) <= expected:  # otherwise none is taken: the first level is made larger
            return None if np.isin(found, inside).any() else Cascade(inside, first, found)
        p /= 4


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (its text, its action); nulls if none does."""
    text = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def judge(pages: DataFrame, listed: Iterable[str] = LISTED_SITES, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    verdict is the longest fitting rule's, else block if the host's site is listed, else allow. A null url, or one
    without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows come out as often as they
    go in, columns other than page_id and url are not read, an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("site", site(F.col("host")))
    cascade, seed = build(split, "site", listed)
    listed_site = F.pandas_udf(lambda h: pd.Series(cascade.test(h.to_numpy())), "boolean")
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(listed_site(F.xxhash64(F.lit(seed), "site")), F.lit("block")).otherwise(F.lit("allow"))
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"))


SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') IN ({", ".join(f"'{x}'" for x in LISTED_SITES)}) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""
