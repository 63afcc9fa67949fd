"""URL rules and lists of hosts and addresses by Bloom filter cascades, in DataFrame functions.

A cascade holds a set of listed keys exactly over a key universe that is known in full: level 0 encodes the listed
keys, level 1 the unlisted keys of the universe that level 0 lets through, level 2 the listed keys that level 1 lets
through, and so on until a level lets none through wrongly. A key of the universe is listed if the first level that
does not hold it is odd. Looking up is arithmetic on literals: no join, no shuffle.

A long list is cut by a hash of the key into parts of their own cascades. The pages then go through as many branches as
keep the bits of a branch under PASS_PARTS parts, each page through the branch of its key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pack, unpack

#: Bits of one level of one part, at most about so many (4 MB).
PART_BITS = 1 << 25
#: Parts whose levels one task holds at a time.
PASS_PARTS = 8
#: From this level on, what is left is kept as a list, if it has at most so many keys.
DEEP, LEFT = 16, 1000


def _bit(key: Column, level: int, probe: int, bits: int) -> Column:
    # Level and probe come first: they seed the hash of the key, so keys that share one of its hashes don't share all.
    return F.pmod(F.xxhash64(F.lit(level), F.lit(probe), key), F.lit(bits).cast("long"))


@dataclass
class Level:
    bits: int
    probes: int
    words: str

    def holds(self, key: Column, level: int) -> Column:
        # One string that the optimizer folds into one array: an array of literals would be a node for each word.
        bitmap = F.split(F.lit(self.words), ",").cast("array<bigint>")
        hit = None
        for probe in range(self.probes):
            at = _bit(key, level, probe, self.bits)
            one = F.getbit(F.element_at(bitmap, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1
            hit = one if hit is None else hit & one
        return hit


@dataclass
class Listed:
    """The last level of a deep cascade: the few keys left, each as it is."""

    keys: list[str]

    def holds(self, key: Column, level: int) -> Column:
        return key.isin(self.keys)


def _encode(keys: DataFrame, n: int, level: int, per_key: int, probes: int) -> Level:
    bits = max(64, -(-n * per_key // 64) * 64)
    at = F.explode(F.array(*[_bit(F.col("key"), level, p, bits) for p in range(probes)]))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b"))
    found = {int(r["w"]): int(r["b"]) for r in words.collect()}
    return Level(bits, probes, ",".join(str(found.get(i, 0)) for i in range(bits // 64)))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts).cast("long"))


@dataclass
class Cascade:
    """The levels of each part of the keys."""

    parts: list[list[Level | Listed]]

    @property
    def levels(self) -> int:
        return max(map(len, self.parts))

    def contains(self, key: Column, parts: list[int] | None = None) -> Column:
        """Exact for keys of the universe that the cascade was built over; null keys are in no list. Of parts given, only
        keys of those are asked."""
        def of(levels: list[Level | Listed]) -> Column:
            out = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                out = F.when(levels[i].holds(key, i), out).otherwise(F.lit(i % 2 == 1))
            return out

        if len(self.parts) == 1:
            return key.isNotNull() & of(self.parts[0])
        at, out = _part(key, len(self.parts)), F.lit(False)
        for k in range(len(self.parts)) if parts is None else parts:
            out = F.when(at == k, of(self.parts[k])).otherwise(out)
        return key.isNotNull() & out

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with the boolean column name: whether its key is listed."""
        n = len(self.parts)
        if n <= PASS_PARTS:
            return df.withColumn(name, self.contains(F.col(key)))
        out = None
        for first in range(0, n, PASS_PARTS):
            own = list(range(first, min(n, first + PASS_PARTS)))
            at = F.coalesce(_part(F.col(key), n), F.lit(0))
            branch = df.filter(at.between(own[0], own[-1])).withColumn(name, self.contains(F.col(key), own))
            out = branch if out is None else out.unionByName(branch)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade of listed over universe; both have a column key, repeats allowed. An empty list gives a cascade that holds nothing.

    With r listed and s other keys level 0 lets through wrongly a share of about r / (s * sqrt(2)), at which the levels
    together are smallest. The universe is read once for its number of keys and once against level 0; every later
    level works on what the one before let through, a fraction that falls geometrically.
    """
    inside = materialize(listed.filter("key is not null").select("key").distinct(), "listed")
    n = inside.count()
    if n == 0:
        return Cascade([[]])
    keys = universe.filter("key is not null").select("key")
    s = max(1, (keys.agg(F.approx_count_distinct("key")).first()[0] or 0) - n)
    through = min(0.5, n / (s * math.sqrt(2)))
    per_key, probes = math.ceil(math.log2(1 / through) / math.log(2)) + 1, max(1, round(math.log2(1 / through)))
    parts = -(-n * per_key // PART_BITS)
    return Cascade([_build_part(inside, keys, part, parts, per_key, probes) for part in range(parts)])


def _build_part(inside: DataFrame, keys: DataFrame, part: int, parts: int, per_key: int, probes: int) -> list[Level | Listed]:
    if parts > 1:
        inside, keys = (df.filter(_part(F.col("key"), parts) == part) for df in (inside, keys))
    n = inside.count()
    if n == 0:
        return []
    levels = [_encode(inside, n, 0, per_key, probes)]
    passed = keys.filter(levels[0].holds(F.col("key"), 0)).distinct()
    wrong, other = materialize(passed.join(inside, "key", "left_anti"), "passed"), inside
    while (n := wrong.count()) > 0:
        level = len(levels)
        if level >= DEEP and n <= LEFT:
            return [*levels, Listed([r["key"] for r in wrong.collect()])]
        # Deep levels get more bits a key, so that even a few keys that share hashes are told apart.
        levels.append(_encode(wrong, n, level, 4 + level // 4, 2))
        wrong, other = materialize(other.filter(levels[-1].holds(F.col("key"), level)), "passed"), wrong
    return levels


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is lower-cased (A-Z); both are empty for null or where there is no ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All rule texts that could fit a url: each suffix of whole labels of its host with each path prefix of a rule's length."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], blocked: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null), verdict and listed.

    rules: (action, text) with action allow or block and the text a host and a path, like ``example.org/es/``; they are
    a short list by nature. A rule fits its host and its subdomains where the path starts with the rule's path.
    blocked has a column key and may be of any length: hosts, or addresses (host and path), whose pages are blocked
    where no rule fits. Membership of all is by exact cascades over all keys that the pages' urls give. Null and
    malformed urls have an empty host and path, fit no rule and are in no list. Repeated rows are judged each by
    itself; an empty table gives an empty result, empty lists block nothing. Added columns replace columns of pages of the same name, in
    any case.
    """
    lengths = sorted({len(text) - text.index("/") for _, text in rules})
    out = pack(pages.select(*[F.col(f"`{c}`") for c in pages.columns])).withColumn("_url", F.col("__row").getField(url).cast("string"))
    host, path = url_parts(F.col("_url"))
    out = out.withColumn("host", host).withColumn("path", path).withColumn("address", F.concat("host", "path"))
    keys = F.when(F.col("host") != "", rule_keys(F.col("host"), F.col("path"), lengths)).otherwise(F.array().cast("array<string>"))
    spark = pages.sparkSession
    rule_universe = out.select(F.explode(keys).alias("key"))

    def listed(action: str) -> DataFrame:
        own = [text for a, text in rules if a == action]
        return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in own]) if own else F.array().cast("array<string>")).alias("key"))

    allow, block = (build_cascade(listed(a), rule_universe) for a in ("allow", "block"))
    fits = F.filter(keys, lambda k: allow.contains(k) | block.contains(k))
    longest = F.aggregate(fits, F.lit(None).cast("string"), lambda a, k: F.when(F.coalesce(F.length(a), F.lit(0)) >= F.length(k), a).otherwise(k))
    named = {}
    if blocked is not None:
        # A key without a slash is a host, or an address without a path, which is the same.
        with_path = F.contains(F.col("key"), F.lit("/"))
        named = {c: build_cascade(blocked.filter(with_path if c == "address" else ~with_path), out.select(F.col(c).alias("key")).filter("key <> ''")) for c in ("host", "address")}
    out = out.withColumn("rule", longest)
    for c in ("host", "address"):
        out = named[c].mark(out, c, f"_{c}") if c in named else out.withColumn(f"_{c}", F.lit(False))
    out = out.withColumn("listed", (F.col("host") != "") & (F.col("_host") | F.col("_address")))
    by_rule = F.when(block.contains(F.col("rule")), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(F.col("listed"), "block").otherwise("allow")
    return unpack(out, pages.columns, **{c: F.col(c) for c in ("host", "path", "rule", "listed")}, verdict=verdict)
