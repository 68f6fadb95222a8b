"""Operator 9, URL filters: cascades of Bloom filters that are exact over the corpus's own keys.

A list of keys has one cascade.  Level 0 encodes the listed keys.  The keys of the corpus that it takes for listed but are
not go into level 1, the listed keys that level 1 wrongly holds go into level 2, and so on until a level errs on no key of
the universe.  Walking down the levels then answers membership exactly for every key that occurs, by bit tests in the
scan: no join, and nothing else of the lists is in the plan.

A key is the last labels of a host, followed by a path prefix, in the numbers of labels and characters that listed keys
have.  Keys that block and keys that allow have a cascade each, so the longest key of a url that either holds is its rule
and that cascade its verdict.  The universe is the distinct keys of the whole corpus.  A level is a bit array of
BITS_PER_KEY bits a key, in one row of a written table that every task reads as a scalar subquery; an executor holds
about a byte for each listed key that occurs, whatever the size of the corpus.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and is allowed; a very long url is
judged like any other; of a key in both lists block decides; without rules all is allowed; repeated rows are judged row by
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, quoted

#: The rules (action, host and path) of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

BITS_PER_KEY, HASHES = 8, 3
#: Bits to a word of a level's image; its sign is left alone.
WORD = 63


@dataclass
class Level:
    """bits of the filter; image: a written table of one row, the array of its words; seed tells levels apart."""

    bits: int
    image: DataFrame
    seed: int

    def holds(self, key: Column) -> Column:
        """True where every bit of the key is set."""
        image = self.image.scalar()
        out = F.lit(True)
        for place in _places(key, self.bits, self.seed):
            out = out & (F.getbit(F.get(image, F.floor(place / WORD).cast("int")), (place % WORD).cast("int")) == 1)
        return out


def _places(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * HASHES + h), key), F.lit(bits).cast("long")) for h in range(HASHES)]


def build_level(keys: DataFrame, count: int, seed: int) -> Level:
    """The Bloom filter of the column key, its words gathered by the executors."""
    bits = max(64, count * BITS_PER_KEY)
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, seed))).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / WORD).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(p % {WORD} AS INT))")).alias("v"))
    every = keys.sparkSession.range(-(-bits // WORD)).select(F.col("id").alias("w"))
    filled = every.join(words, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    image = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("image"))
    return Level(bits, materialise(image, f"bloom-image-{seed}"), seed)


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels that answer exactly whether a key of universe (column key, distinct) is in listed.

    Each round keeps only keys that the last level errs on, so the sets shrink by the filters' error rate.
    """
    inside = materialise(universe.join(listed.select("key").distinct(), "key", "left_semi"), "bloom-listed")
    outside = universe.join(listed.select("key").distinct(), "key", "left_anti")
    levels: list[Level] = []
    while count := inside.count():
        level = build_level(inside, count, len(levels))
        levels.append(level)
        wrong = materialise(outside.filter(level.holds(F.col("key"))), f"bloom-{len(levels)}")
        inside, outside = wrong, inside
    return levels


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership of a key of the universe: the first level that denies it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    tail = F.substring(rest, F.char_length(host) + 1, F.lit(1 << 30))
    return ascii_lower(host), F.regexp_extract(tail, r"\A([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """A table (action, rule) of a short list, made by the JVM alone."""
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule")) for a, r in rules]) if rules else F.expr("CAST(array() AS array<struct<action: string, rule: string>>)")
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _shape(rule: Column) -> Column:
    """(labels, path): how many labels of a host and characters of a path a key has; path is 0 for a host alone."""
    host = F.substring_index(rule, "/", 1)
    return F.struct(F.size(F.split(host, r"\.")).alias("labels"), (F.char_length(rule) - F.char_length(host)).alias("path"))


def _key(labels: int, chars: int) -> Column:
    """The key of that shape of (host, path); null where they are too short for it."""
    long_enough = (F.col("host") != "") & (F.size(F.split("host", r"\.")) >= labels) & (F.char_length("path") >= chars)
    return F.when(long_enough, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str]] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (the longest that fits, else null) and verdict ('allow' or 'block') of each row.

    rules are pairs, or a table, of action ('allow' or 'block') and rule: a lower-case host, then a path or nothing; a
    rule without a path fits all pages of its host and the hosts below.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rules_table(spark, rules)
    listed = materialise(table.groupBy(F.col("rule").alias("key")).agg(F.max("action").alias("action")).filter("key <> ''"), "bloom-rules")
    # As many as there are shapes of keys, whatever the number of rules.
    shapes = sorted((r[0], r[1]) for r in listed.select(_shape(F.col("key")).alias("s")).select("s.labels", "s.path").distinct().collect())
    host, path = host_and_path(F.col(quoted(url_col)))
    parsed = pages.select(F.col(quoted(id_col)).alias("id"), host.alias("host"), path.alias("path"))
    keyed = parsed.select("id", "host", "path", *[_key(*s).alias(f"key{i}") for i, s in enumerate(shapes)])
    fits, verdict = [], F.lit("allow")
    if shapes:
        each = keyed.select(F.explode(F.array(*[F.col(f"key{i}") for i in range(len(shapes))])).alias("key")).filter("key IS NOT NULL")
        # One row a key, and no task has all of a frequent one.
        universe = materialise(each.groupBy("key").agg(F.count("*").alias("n")).select("key"), "bloom-universe")
        cascades = {a: build_cascade(universe, listed.filter(F.col("action") == a)) for a in ("block", "allow")}
        for i in range(len(shapes)):
            key = F.col(f"key{i}")
            found = F.when(member(key, cascades["block"]), F.lit("block")).when(member(key, cascades["allow"]), F.lit("allow"))
            hit = F.when(key.isNotNull() & found.isNotNull(), F.struct(F.char_length(key).alias("n"), key.alias("rule"), found.alias("action")))
            fits.append(hit)
    if not fits:
        return parsed.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"))
    # Written: the optimizer would copy the levels' tests into every expression over a verdict.
    told = materialise(keyed.select("id", "host", "path", F.array_max(F.array(*fits)).alias("best")), "bloom-judged")
    return told.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", verdict).alias("verdict"))
