"""URL filters: a Bloom filter cascade, built and probed with DataFrame functions only.

Level 0 encodes the listed keys. Level 1 encodes those keys of the universe that
level 0 lets through by mistake, level 2 the listed keys that level 1 lets
through, and so on until no mistake is left. Over the universe the cascade is
thus exact, and a probe is a few bit tests on literals: no join.

The filters are sent to every task, so their size is checked: a level takes at
most ``max_bits`` bits. A small list gets more bits a key where the universe is
large, so that few mistakes are left for the next level. A list or universe that is
too large for one cascade is cut into shards by a hash of the key; ``mark_listed``
then passes over the rows once for each shard, with that shard's cascade alone.
However long the list, there is no join and no task holds more than one level's bits
a level.

Defined cases: a null key is never listed; keys may repeat; an empty list or an
empty universe gives a cascade that lists nothing. A null url or one without
``://`` has an empty host and path, fits no rule and is allowed. Of rules of
equal length, that with the longer host wins. Repeated rows give repeated
results; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

BITS_PER_KEY = 12
HASHES = 5
MAX_BITS = 1 << 24


class CascadeTooLarge(ValueError):
    """One cascade would take more bits than may be sent to every task."""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"),
)

#: Domains that the block list names, each with all its subdomains.
LISTED_DOMAINS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def _positions(key: Column, bits: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


@dataclass(frozen=True)
class Level:
    bits: int
    words: str

    def passes(self, key: Column, level: int) -> Column:
        held = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to one literal
        out = F.lit(True)
        for p in _positions(key, self.bits, level):
            out = out & (F.bit_get(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].passes(key, i), out).otherwise(F.lit(i % 2 == 1))
        return F.when(key.isNotNull(), out).otherwise(F.lit(False))


def layout(n: int, universe: int, max_bits: int) -> tuple[int, int]:
    """Shards, and bits of their first level, for ``n`` listed keys among ``universe`` others."""
    shards = 1
    while True:
        mine, others = n / shards, universe / shards
        bits = max(256, -(-math.ceil(mine * BITS_PER_KEY) // 64) * 64)
        mistaken = lambda bits, mine=mine, others=others: others * (1 - math.exp(-HASHES * mine / bits)) ** HASHES * BITS_PER_KEY
        while 2 * bits <= max_bits and mistaken(bits) > bits:
            bits *= 2
        if bits <= max_bits and mistaken(bits) <= max_bits:
            return shards, bits
        shards *= 2


def _filter(keys: DataFrame, bits: int, level: int) -> Level:
    """One Bloom filter of the keys in the column ``key``; its words, of bounded number, come to the driver."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, level))).alias("p"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")).collect()
    words = ["0"] * (bits // 64)
    for r in rows:
        words[r["w"]] = str(r["m"])
    return Level(bits, ",".join(words))


def _keys(listed: DataFrame, universe: DataFrame) -> tuple[DataFrame, int, int]:
    """(key, listed), each key once, and the numbers of keys that are listed and not."""
    both = listed.select("key", F.lit(1).alias("l")).unionByName(universe.select("key", F.lit(0).alias("l")))
    keys = stage(both.where(F.col("key").isNotNull()).groupBy("key").agg((F.max("l") == 1).alias("listed")), "url-keys")
    n = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    return keys, n.get(True, 0), n.get(False, 0)


def _cascade(keys: DataFrame, bits: int, max_bits: int, max_levels: int) -> Cascade:
    levels: list[Level] = []
    inside = {side: keys.where(F.col("listed") == side) for side in (True, False)}
    while True:
        side = len(levels) % 2 == 0
        n = inside[side].count()
        if n == 0 and levels:
            return Cascade(tuple(levels))
        if len(levels) == max_levels or 2 * n > max_bits:
            raise CascadeTooLarge(f"{n} keys are still mistaken after {len(levels)} levels")
        bits = bits if not levels else min(max_bits, max(256, -(-n * BITS_PER_KEY // 64) * 64))
        level = _filter(inside[side], bits, len(levels))
        inside[not side] = inside[not side].where(level.passes(F.col("key"), len(levels)))
        levels.append(level)


def build_cascade(listed: DataFrame, universe: DataFrame, *, max_bits: int = MAX_BITS, max_levels: int = 24) -> Cascade:
    """One cascade for the column ``key`` of ``listed``, exact over the keys of both frames; ``CascadeTooLarge`` if it takes several."""
    keys, n, others = _keys(listed, universe)
    shards, bits = layout(n, others, max_bits)
    if shards > 1:
        raise CascadeTooLarge(f"{n} keys among {others} take {shards} cascades of levels of {max_bits} bits")
    return _cascade(keys, bits, max_bits, max_levels)


def mark_listed(rows: DataFrame, key_col: str, listed: DataFrame, *, max_bits: int = MAX_BITS, max_levels: int = 24, out: str = "is_listed") -> DataFrame:
    """``rows`` with a boolean, by cascades that are exact over their own keys: one pass over the rows for each shard of the list."""
    key = F.col(key_col)
    keys, n, others = _keys(listed, rows.select(key.alias("key")))
    shards, bits = layout(n, others, max_bits)
    if shards == 1:
        return rows.withColumn(out, _cascade(keys, bits, max_bits, max_levels).contains(key))
    shard = lambda k: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(shards))
    dealt = stage(keys.withColumn("shard", shard(F.col("key"))), "sharded-keys")
    rows = rows.withColumn(out, F.lit(False))
    for i in range(shards):
        mine = F.coalesce(shard(key) == i, F.lit(False))
        cascade = _cascade(dealt.where(F.col("shard") == i), bits, max_bits, max_levels)
        rows = stage(rows.withColumn(out, F.when(mine, cascade.contains(key)).otherwise(F.col(out))), "marked-rows")
    return rows


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, path_lengths: list[int]) -> Column:
    """The keys under which a url can be listed, as structs of (key, host characters): host endings of up to ``labels`` labels, alone and with the start of the path."""
    ends = F.array_distinct(F.array(*(F.substring_index(host, ".", -i) for i in range(1, labels + 1))))
    starts = F.array_distinct(F.array(F.lit(""), *(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths)))
    starts = F.filter(starts, lambda s: s.isNotNull())
    one = lambda e, s: F.struct(F.concat(e, s).alias("key"), F.length(e).alias("host_chars"))
    return F.filter(F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: one(e, s)))), lambda c: c["host_chars"] > 0)


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, domains: tuple[str, ...] = LISTED_DOMAINS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row: the longest rule that fits, else block if the host's domain is listed, else allow."""
    spark = pages.sparkSession
    labels = max(k.count(".") + 1 for k in [*(r.host for r in rules), *domains, ""])
    lengths = sorted({len(r.path) for r in rules} - {0})
    split = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = split.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = keyed.select(F.explode("_keys.key").alias("key"))
    frame = lambda keys: spark.range(1).select(F.explode(F.array(*map(F.lit, sorted({*keys})))).alias("key"))
    rule_keys = [r.key for r in rules]
    listed = build_cascade(frame([*rule_keys, *domains]), universe)
    as_rule = build_cascade(frame(rule_keys), frame(domains))
    allowed = build_cascade(frame([r.key for r in rules if r.verdict == "allow"]), frame(rule_keys))
    found = keyed.withColumn("_hits", F.filter("_keys", lambda c: listed.contains(c["key"])))
    best = F.array_max(F.transform(F.filter("_hits", lambda c: as_rule.contains(c["key"])), lambda c: F.struct(F.length(c["key"]).alias("n"), c["host_chars"].alias("h"), c["key"].alias("key"))))
    judged = found.withColumn("rule", best["key"])
    by_rule = F.when(allowed.contains(F.col("rule")), "allow").otherwise("block")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(F.size("_hits") > 0, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def oracle_sql(rules: tuple[Rule, ...] = RULES, domains: tuple[str, ...] = LISTED_DOMAINS) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rule_rows = ", ".join(f"({quoted(r.host)}, {quoted(r.path)}, {quoted(r.verdict)})" for r in rules)
    domain_rows = ", ".join(f"({quoted(d)})" for d in domains)
    return f"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES {rule_rows}),
d(domain) AS (VALUES {domain_rows}),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
         arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id),
b AS (SELECT DISTINCT page_id FROM p JOIN d ON host = domain OR ends_with(host, '.' || domain))
SELECT p.page_id, p.host, p.path, m.rule AS rule,
       CASE WHEN m.rule IS NOT NULL THEN m.verdict WHEN b.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id LEFT JOIN b ON p.page_id = b.page_id"""
