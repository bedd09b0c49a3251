"""URL filters: prefix rules, and exact set membership by a Bloom filter cascade.

The cascade knows the complete universe of keys.  Level 1 is a Bloom filter of the
listed keys; level 2 one of the unlisted keys that pass level 1; level 3 one of the
listed keys that pass level 2; and so on until no false positive is left.  A key's
verdict is the parity of the first level that rejects it, exact for every key of the
universe.  Filters are arrays of 64-bit words made by ``bit_or`` and read as scalar
subqueries, so tests join nothing; their size follows the list, not the corpus.  All of
it is DataFrame functions.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule
and are not listed; an empty list blocks nothing; repeated rows are judged alike; an
empty table gives an empty result; columns of the input other than the key and url
columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _cuts


class Cascade:
    """Exact membership in a list, for all keys of a universe."""

    def __init__(self, levels: list[tuple[DataFrame, int, int]]):
        self.levels = levels

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame) -> Cascade:
        """From one-column tables of keys; the universe may hold listed keys, nulls and repeats."""
        listed = _cuts.written(listed.toDF("key").where("key is not null").distinct())
        rest = universe.toDF("key").where("key is not null").distinct().join(listed, "key", "left_anti")
        inside, outside, levels = listed, _cuts.written(rest), []
        n, m = inside.count(), outside.count()
        while n:
            rate = 0.5 if levels else min(0.5, n / (math.sqrt(2) * max(1, m)))
            hashes = max(1, round(-math.log2(rate)))
            words = math.ceil(n * hashes / math.log(2) / 64) + 1
            level = (_bloom(inside, len(levels), hashes, words), hashes, words)
            levels.append(level)
            inside, outside = _cuts.written(outside.where(_passes(F.col("key"), len(levels) - 1, *level))), inside
            n, m = inside.count(), n
        return Cascade(levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(_passes(key, i, *self.levels[i]), verdict).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(key.isNotNull() & verdict, F.lit(False))


def _place(key: Column, level: int, i: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(64 * words).cast("long"))


def _bloom(keys: DataFrame, level: int, hashes: int, words: int) -> DataFrame:
    """One row: the filter's words, zeros included."""
    at = keys.select(F.explode(F.array(*(_place(F.col("key"), level, i, words) for i in range(hashes)))).alias("at"))
    word = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    zero = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = word.union(zero).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return _cuts.written(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")))


def _passes(key: Column, level: int, bloom: DataFrame, hashes: int, words: int) -> Column:
    bits = bloom.scalar()
    out = F.lit(True)
    for i in range(hashes):
        at = _place(key, level, i, words)
        out = out & (F.getbit(F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column, labels: int = 3) -> Column:
    """The host's last labels; null for an empty host."""
    return F.when(host != "", F.substring_index(host, ".", -labels))


def fits(host: Column, path: Column, rule: str) -> Column:
    """Whether ``rule`` (``host/path``) fits the url's host or a parent of it, and its path."""
    at = rule.index("/")
    return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])


def judge(pages: DataFrame, rules: dict[str, str], cascade: Cascade) -> DataFrame:
    """page_id, host, path, rule (the longest that fits) and verdict of every row.

    ``rules`` maps rules to allow or block; where none fits, listed sites are blocked.
    """
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    longest = sorted(rules, key=lambda r: (-len(r), r))
    rule = F.coalesce(*(F.when(fits(host, path, r), F.lit(r)) for r in longest), F.lit(None).cast("string"))
    df = df.withColumn("rule", rule)
    said = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()), F.lit(None).cast("string"))
    return df.withColumn("verdict", F.coalesce(said, F.when(cascade.contains(site_of(host)), "block").otherwise("allow")))
