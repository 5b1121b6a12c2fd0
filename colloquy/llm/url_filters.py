"""URL rules through a cascade of Bloom filters, in DataFrame functions only.

A rule is a host and a path prefix (``net/de/``).  The keys of a url are the strings of that
form which could be a rule for it: a host suffix of so many labels, followed by a path prefix
of so many characters, for every such shape among the rules.  The key universe of a corpus is
all keys of all its urls.

Level 1 of the cascade encodes the listed keys.  Level 2 encodes the keys of the universe that
level 1 takes for listed by mistake, level 3 the listed keys that level 2 takes for those, and
so on, until no mistake is left.  The first level that rejects a key then tells exactly whether
it is listed, for every key of the universe, with bit tests on a few arrays and no join.  The
matched key is itself the rule's text, so nothing has to be looked up; a second cascade over
the matched keys tells the blocking rules from the allowing ones.

Sizes: level 1 has a rate of mistakes of r / (s * sqrt 2) for r listed keys in a universe of s,
the others have one half, so all levels together take about 1.44 r log2(s / r) + 4 r bits: they
grow with the list, and only with the logarithm of the corpus.  A list whose first level would
pass ``max_bits`` (16 MB by default) is looked up by an equi join instead, which is as exact.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule.  A
host with fewer labels, or a path with fewer characters, than a shape asks for has no key of
that shape.  Of several fitting rules the longest text wins, then the longer host.  Equal rules
with both verdicts count as blocking.  Repeated rows are judged alike; an empty table or list
gives no rows or no matches.  Extra columns pass through; the operator's own columns replace
columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, stored, table

ALLOW, BLOCK = "allow", "block"
MAX_BITS = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: DataFrame  # one row, one column: the bits as an array of longs
    bits: int
    hashes: int
    salt: int


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, shapes: Iterable[tuple[int, int]]) -> Column:
    """Keys of a url, one for each shape (labels, path characters) that it reaches."""
    labels = F.size(F.split(host, r"\."))
    found = [
        F.when(
            (host != "") & (labels >= n) & (F.length(path) >= m),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)),
        )
        for n, m in shapes
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def bit(key: Column, level: Level, j: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level.salt), F.lit(j)), F.lit(level.bits).cast("long"))


def encode(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter over ``keys.key`` as one row; bits are or-ed before the shuffle."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    empty = Level(keys, bits, hashes, salt)
    at = keys.select(F.explode(F.array(*[bit(F.col("key"), empty, j) for j in range(hashes)])).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v")
    )
    filled = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))
    )
    return Level(stored(filled.select(dense.alias("words")), "bloom"), bits, hashes, salt)


def holds(key: Column, level: Level, words: Column) -> Column:
    def test(j: int) -> Column:
        at = bit(key, level, j)
        word = F.get(words, F.floor(at / 64).cast("int"))
        return F.call_function("getbit", word, (at % 64).cast("int")) == 1

    return reduce(lambda a, b: a & b, [test(j) for j in range(level.hashes)])


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def attach(self, df: DataFrame, prefix: str) -> DataFrame:
        """Put the filters on the rows as constants (scalar subqueries)."""
        return df.withColumns({f"{prefix}{i}": lv.words.scalar() for i, lv in enumerate(self.levels)})

    def contains(self, key: Column, prefix: str) -> Column:
        """The first level that rejects decides: an odd one says no, an even one says yes."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            level = self.levels[i]
            answer = F.when(~holds(key, level, F.col(f"{prefix}{i}")), F.lit(i % 2 == 1)).otherwise(answer)
        return answer

    def columns(self, prefix: str) -> list[str]:
        return [f"{prefix}{i}" for i in range(len(self.levels))]


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS, salt: int = 0) -> Cascade | None:
    """The cascade for ``listed.key`` over ``universe.key``; None if level 1 would pass ``max_bits``.

    Level 1 needs one pass over the universe; every later level reads only the mistakes of the
    one before, about half as many each time, from a written table.
    """
    listed = stored(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed")
    r = listed.count()
    if r == 0:
        return Cascade(())
    s = max(universe.count(), 1)
    rate = min(0.5, max(r / (s * math.sqrt(2)), 1e-18))
    if -r * math.log(rate) / math.log(2) ** 2 > max_bits:
        return None
    levels: list[Level] = []
    inside, outside, n = listed, universe.select("key"), r
    while n:
        level = encode(inside, n, rate if not levels else 0.5, salt + len(levels))
        levels.append(level)
        one = Cascade((level,))
        passed = one.attach(outside, "_w").where(one.contains(F.col("key"), "_w")).select("key")
        if len(levels) == 1:
            passed = passed.distinct().join(listed, "key", "left_anti")
        mistakes = stored(passed, "mistakes")
        inside, outside, n = mistakes, inside, mistakes.count()
    return Cascade(tuple(levels))


def host_length(rule: Column) -> Column:
    slash = F.instr(rule, "/")
    return F.when(slash == 0, F.length(rule)).otherwise(slash - 1)


def rule_frame(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules as (verdict, host and path in one text, such as ``net/de/``)."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels, path characters) of the rules: few, however long the list is."""
    host = F.regexp_extract("rule", r"(?s)^([^/]*)", 1)
    n, m = F.size(F.split(host, r"\.")), F.length("rule") - F.length(host)
    return sorted((r["n"], r["m"]) for r in rules.select(n.alias("n"), m.alias("m")).distinct().collect())


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", unlisted: str = ALLOW, max_bits: int = MAX_BITS
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row; ``rules`` has (verdict, rule)."""
    rules = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
    shapes = shapes_of(rules)
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    keyed = split.withColumn("_keys", url_keys(F.col("host"), F.col("path"), shapes))
    universe = keyed.select(F.explode("_keys").alias("key"))
    listed = rules.select(F.col("rule").alias("key"))
    blocking = rules.where(F.col("verdict") == BLOCK).select(F.col("rule").alias("key"))
    known = build_cascade(listed, universe, max_bits)
    # the second universe is the first cascade's answer: the listed keys themselves
    blocks = None if known is None else build_cascade(blocking, listed, max_bits, salt=1000)
    if known is None or blocks is None:
        return joined_rules(keyed, rules, unlisted)
    keyed = blocks.attach(known.attach(keyed, "_known"), "_block")
    hits = F.transform(
        F.filter("_keys", lambda k: known.contains(k, "_known")),
        lambda k: F.struct(F.length(k).alias("n"), host_length(k).alias("h"), k.alias("k")),
    )
    rule = F.array_max(hits)["k"]
    verdict = F.when(F.col("rule").isNull(), unlisted).when(blocks.contains(F.col("rule"), "_block"), BLOCK)
    return (
        keyed.withColumn("rule", rule)
        .withColumn("verdict", verdict.otherwise(ALLOW))
        .drop("_keys", *known.columns("_known"), *blocks.columns("_block"))
    )


def joined_rules(keyed: DataFrame, rules: DataFrame, unlisted: str) -> DataFrame:
    """The other way, for lists past the size bound: look up each distinct key by an equi join."""
    one = rules.groupBy(F.col("rule").alias("_k")).agg(F.max("verdict").alias("_v"))  # block sorts after allow
    row = keyed.withColumn("_row", F.struct(F.xxhash64(*[F.col(f"`{c}`") for c in ("host", "path")]), "host", "path"))
    found = (
        row.select("_row", F.explode("_keys").alias("_k"))
        .distinct()
        .join(one, "_k")
        .groupBy("_row")
        .agg(F.max(F.struct(F.length("_k").alias("n"), host_length(F.col("_k")).alias("h"), "_k", "_v")).alias("_best"))
    )
    return (
        row.join(found, "_row", "left")
        .withColumn("rule", F.col("_best._k"))
        .withColumn("verdict", F.coalesce(F.col("_best._v"), F.lit(unlisted)))
        .drop("_keys", "_row", "_best")
    )


# The rules of the query.
RULES = (
    (BLOCK, "com/en/"),
    (ALLOW, "example.com/en/7"),
    (ALLOW, "net/de/"),
    (BLOCK, "example.net/de/8"),
    (BLOCK, "org/es/"),
)

SQL = r"""
WITH cut AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
    END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op1_url_filters", SQL)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_frame(spark, RULES)).drop("url")
