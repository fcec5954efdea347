"""URL filters: path rules by longest fit, and an exact listed-domain test by a cascade of Bloom filters.

The cascade knows its complete key universe (every host of the table and every parent domain of one). Level 0 encodes
the listed keys, level 1 the unlisted keys that pass level 0, level 2 the listed keys that pass level 1, and so on
until a level has nothing to encode. A key of the universe is then judged without error by walking the levels, and the
walk is an expression on literals: no join, no Python.

Bits go into the plan only up to ``max_bits``; a longer list is judged by an equi-join on the keys instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import UPPER, Scratch


@dataclass(frozen=True)
class Rule:
    """An entry of the rule list: verdict for a host, its subdomains and the paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: m bits in 64-bit words, k probes, seed."""

    seed: int
    m: int
    k: int
    words: tuple[int, ...]


def lowered(host: Column) -> Column:
    """A-Z lower-cased and nothing else, for hosts and listed domains alike."""
    return F.translate(host, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.substr(url, F.locate("://", url) + 3)
    host = lowered(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty for null or without ://."""
    rest = F.substr(url, F.locate("://", url) + 3)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """field (text or verdict) of the longest rule that fits, else null. Among equally long ones a longer host wins, then the smaller text."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.lit(getattr(r, field))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def domains_of(host: Column) -> Column:
    """The host and every parent domain of it: a.b.c gives a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def probes(key: Column, seed: int, m: int, k: int) -> list[Column]:
    """Bit positions of a key by double hashing."""
    a, b = F.xxhash64(F.lit(seed), key), F.xxhash64(key, F.lit(~seed))
    return [F.pmod(F.pmod(a, F.lit(m)) + F.lit(j) * F.pmod(b, F.lit(m)), F.lit(m)) for j in range(k)]


def passes(key: Column, level: Level) -> Column:
    """Whether a key passes one filter: true for each key that it encodes, rarely for another."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    out = F.lit(True)
    for p in probes(key, level.seed, level.m, level.k):
        out = out & (F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
    return out


def listed(key: Column, levels: list[Level]) -> Column:
    """The exact answer for a key of the universe: the level at which the walk ends tells the side."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~passes(key, level), F.lit(i % 2 == 1)).otherwise(out)
    return out


def bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The filter for n keys of column key at a false-positive rate; the bits are or-ed on the executors."""
    m = max(64, 64 * math.ceil(n * 1.4427 * math.log2(1 / rate) / 64))
    k = max(1, round(math.log2(1 / rate)))
    bits = keys.select(F.explode(F.array(*probes(F.col("key"), seed, m, k))).alias("p"))
    words = bits.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("v"))
    got = dict(words.collect())  # at most max_bits / 64 rows
    return Level(seed, m, k, tuple(got.get(i, 0) for i in range(m // 64)))


def build_cascade(universe: DataFrame, keys: DataFrame, max_bits: int) -> list[Level] | None:
    """Levels for the listed keys within the universe (both with one column key, distinct); None if they need more than max_bits."""
    inside = universe.join(keys, "key", "left_semi")
    outside = universe.join(keys, "key", "left_anti")
    n_in, n_out = inside.count(), outside.count()
    rate = min(0.5, max(1e-6, n_in / max(1, n_out) / math.sqrt(2)))
    sides, sizes, levels, spent = [inside, outside], [n_in, n_out], [], 0
    while sizes[0]:
        need = max(64, 64 * math.ceil(sizes[0] * 1.4427 * math.log2(1 / rate) / 64))
        spent += need
        if spent > max_bits:
            return None
        level = bloom(sides[0], sizes[0], rate, len(levels))
        levels.append(level)
        passed = sides[1].filter(passes(F.col("key"), level))
        sides, sizes, rate = [passed, sides[0]], [passed.count(), sizes[0]], 0.5
    return levels


def judge_urls(pages: DataFrame, rules: list[Rule], listed_domains: DataFrame, *, id_col: str = "page_id", url_col: str = "url", max_bits: int = 1 << 23) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages.

    A rule that fits gives its verdict. Otherwise a host is blocked if it or a parent domain is in listed_domains (its
    first column), else allowed. Null urls and urls without :// have an empty host and path: no rule fits, the verdict
    is allow unless '' is listed. Urls of any length are judged whole. Repeated rows are judged each, an empty table gives an empty one, other columns are
    ignored, and null or repeated listed domains count once or not at all.
    """
    keys = listed_domains.select(lowered(F.col(listed_domains.columns[0])).alias("key")).filter(F.col("key").isNotNull()).distinct()
    rows = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    with Scratch(pages.sparkSession) as scratch:
        universe = scratch.stage(rows.select("host").distinct().select(F.explode(domains_of(F.col("host"))).alias("key")).distinct(), "url-keys")
        levels = build_cascade(universe, keys, max_bits)
    if levels is None:
        hosts = rows.select("host").distinct().withColumn("key", F.explode(domains_of(F.col("host"))))
        marked = hosts.join(keys, "key", "left_semi").select("host").distinct().withColumn("hit", F.lit(True))
        judged = rows.join(marked, "host", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    else:
        judged = rows.withColumn("hit", F.exists(domains_of(F.col("host")), lambda d: listed(d, levels)))
    by_rule = fitting_rule(F.col("host"), F.col("path"), rules, "verdict")
    return judged.select(
        id_col, "host", "path", fitting_rule(F.col("host"), F.col("path"), rules, "text").alias("rule"),
        F.coalesce(by_rule, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
    )
