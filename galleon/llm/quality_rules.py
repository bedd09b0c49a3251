"""Quality rules as weak supervision, in DataFrame functions only.

Rules look at whole-text counts and vote good (1), bad (-1) or abstain (0).  Nobody
says how far a rule is to be trusted: expectation maximisation over the counts of vote
patterns (at most ``3 ** rules`` rows, whatever the corpus) estimates it.  Kinds of junk
rarely overlap, so a rule that knows one kind is wrong about the others; documents are
therefore taken to be good or of one of the ``KINDS`` of junk, and estimated are the
share of each class and how often each rule votes good on it, where it votes at all.  A
document is kept where its posterior probability of being good is at least ``keep_at``.
Hard floors (``base_failed``) come before the verdict; documents under them vote too,
as they show what junk looks like.

The votes alone do not say which class is which.  Estimation starts where most
documents are good, and where the rules listed for a kind vote bad on it; the start
weighs as much as ``WEIGHT`` documents and votes, so it decides in tiny tables only.

Defined cases: a null text counts as no words; texts without words fail the floor;
repeated rows are judged alike; an empty table gives an empty result; extra columns,
also ones named like the results, do not matter to ``judge`` (it reads ``doc_id`` and
``text``), and ``keep`` returns the input's columns as they were.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _cuts

#: Kinds of junk, and the rules that are expected to vote bad on them.
KINDS: dict[str, tuple[str, ...]] = {
    "marks": ("symbols", "plain_words"),
    "repetition": ("repeats", "echoes", "lines", "variety"),
    "shouting": ("shouting", "capitals"),
    "shape": ("length", "word_length", "line_ends"),
}
#: Where estimation starts: the share of good documents; good votes of a rule on these, on junk it knows, on other junk.
SHARE, ON_GOOD, KNOWN, UNKNOWN = 0.85, 0.97, 0.2, 0.9
#: So many documents, and votes of each rule on each class, does the start count for.
WEIGHT = 2.0
#: name -> (bad if, good if); neither: the rule abstains
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 12", "n_words >= 40"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "plain_words": ("10 * n_plain < 6 * n_words", "10 * n_plain >= 8 * n_words"),
    "line_ends": ("n_lines > 0 and 10 * n_ended < n_lines", "2 * n_ended >= n_lines"),
    "repeats": ("100 * n_repeat_words > 15 * n_words", "n_repeat_words = 0"),
    "echoes": ("10 * n_echoes > n_words", "100 * n_echoes <= 2 * n_words"),
    "lines": ("10 * n_dup_lines > 5 * n_lines", "n_dup_lines = 0"),
    "word_length": ("2 * word_chars < 5 * n_words or word_chars > 15 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
    "shouting": ("10 * n_upper > 4 * word_chars", "10 * n_upper <= word_chars"),
    "capitals": ("10 * n_caps > 4 * n_words", "10 * n_caps <= n_words"),
    "variety": ("100 * n_distinct < 25 * n_words", "100 * n_distinct >= 40 * n_words"),
}
#: Long texts repeat more of their words, so distinct words are counted in each stretch of so many words and added up.
STRETCH = 400
#: A word of letters, with marks before and after it as prose has them.
PLAIN = r"(?:^|[ \t\n\x0b\f\r])[(\[\"'«“‘¿¡]*+\p{L}++(?:['’-]\p{L}++)*+[.,;:!?…)\]\"'»”’]*+(?=[ \t\n\x0b\f\r]|\z)"
#: A word of two letters or more, all of them A-Z.
CAPS = r"(?<![^ \t\n\x0b\f\r])[A-Z]{2,}+(?!\p{L})"
#: A line's end after a mark that ends sentences.
ENDED = r"[.!?:;\u2026\"'\u201d\u2019\u00bb)\u3002][\x20\x09\x0B-\x0D]*+(?=\n|\z)"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHER = ("n_lines", "n_upper", "n_distinct", "n_plain", "n_echoes", "n_ended", "n_caps")


def counts(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the whole-text counts as columns ``prefix + name``.

    Every expression stays in the row: no shuffle, no Python, whatever one document
    repeats.  ``n_distinct`` adds up the distinct words of all consecutive stretches of
    ``STRETCH`` words.  Repeated windows are found by sorting the hashes of a text's own
    5-word windows, and only in texts where two of them are equal.
    """
    p = prefix
    c = lambda name: F.col(p + name)
    df = docs.withColumn(p + "body", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    df = df.withColumn(p + "w", F.array_remove(F.split(c("body"), "[\\x20\\x09-\\x0D]++"), ""))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c("w"))), F.lit(STRETCH))
    df = df.withColumns({
        p + "n_words": F.size(c("w")).cast("long"),
        p + "n_distinct": F.aggregate(starts, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice(c("w"), i, STRETCH)))).cast("long"),
        p + "word_chars": F.char_length(F.array_join(c("w"), "")).cast("long"),
        p + "n_symbols": F.regexp_count(c("body"), F.lit(r"[#*$%&|<>]")).cast("long"),
        p + "n_upper": F.regexp_count(c("body"), F.lit("[A-Z]")).cast("long"),
        p + "n_caps": F.regexp_count(c("body"), F.lit(CAPS)).cast("long"),
        p + "n_plain": F.regexp_count(c("body"), F.lit(PLAIN)).cast("long"),
        p + "n_ended": F.regexp_count(c("body"), F.lit(ENDED)).cast("long"),
        p + "l": F.filter(F.split(c("body"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        p + "x": F.transform(c("w"), lambda x: F.xxhash64(x)),
    })
    df = df.withColumn(p + "h", F.when(
        F.size(c("x")) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(c("x")) - 5), lambda i: F.xxhash64(*(F.get(c("x"), i + k) for k in range(5)))),
    ))
    df = df.withColumns({
        p + "n_lines": F.size(c("l")).cast("long"),
        p + "n_echoes": F.size(F.filter(c("x"), lambda x, i: x == F.get(c("x"), i - 1))).cast("long"),
        p + "n_dup_lines": (F.size(c("l")) - F.size(F.array_distinct(c("l")))).cast("long"),
        p + "s": F.when(
            F.size(F.array_distinct(c("h"))) < F.size(c("h")),
            F.array_sort(F.transform(c("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    })
    same = lambda x, i: x["h"].eqNullSafe(F.get(c("s"), i - 1)["h"]) | x["h"].eqNullSafe(F.get(c("s"), i + 1)["h"])
    df = df.withColumn(p + "at", F.array_sort(F.transform(F.filter(c("s"), same), lambda x: x["i"])))
    steps = F.transform(c("at"), lambda a, i: F.least(F.lit(5), F.coalesce(F.get(c("at"), i + 1) - a, F.lit(5))))
    df = df.withColumn(p + "n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long"))
    # a generator of one row: filters above read its columns instead of evaluating the counts again
    made = F.struct(*(c(x).alias(p + x) for x in (*COUNTS, *OTHER)))
    return df.select(*(F.col(f"`{x}`") for x in docs.columns), F.inline(F.array(made)))


def _rule(sql: str, prefix: str) -> Column:
    for name in (*COUNTS, *OTHER):
        sql = sql.replace(name, f"`{prefix}{name}`")
    return F.expr(sql)


def base_failed(prefix: str = "_q_") -> Column:
    """The hard floor: too short, or more than a fifth of the words in repeated windows."""
    return (F.col(prefix + "n_words") < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * F.col(prefix + "n_words"))


def votes(prefix: str = "_q_") -> Column:
    """Array of the rules' votes, in the order of ``RULES``."""
    return F.array(*(F.when(_rule(bad, prefix), -1).when(_rule(good, prefix), 1).otherwise(0) for bad, good in RULES.values()))


class Estimates(NamedTuple):
    """Shares of the classes (good ones first), and how often each rule's votes on each class are good."""

    share: list[float]
    good_votes: list[list[float]]

    def odds(self) -> list[tuple[float, list[tuple[float, float]]]]:
        """For each kind of junk: its log odds against good before votes, and what a bad and a good vote of each rule add."""
        ok, *junk = self.good_votes
        return [
            (math.log(share / self.share[0]), [(math.log((1 - y) / (1 - x)), math.log(y / x)) for x, y in zip(ok, kind, strict=True)])
            for share, kind in zip(self.share[1:], junk, strict=True)
        ]


def start() -> Estimates:
    junk = [[KNOWN if rule in known else UNKNOWN for rule in RULES] for known in KINDS.values()]
    return Estimates([SHARE, *[(1 - SHARE) / len(KINDS)] * len(KINDS)], [[ON_GOOD] * len(RULES), *junk])


def memberships(votes: list[int], odds: list[tuple[float, list[tuple[float, float]]]]) -> list[float]:
    """Posterior probability of each class."""
    logs = [0.0] + [prior + sum(good if v > 0 else bad for v, (bad, good) in zip(votes, rules, strict=True) if v) for prior, rules in odds]
    top = max(logs)
    parts = [math.exp(x - top) for x in logs]
    return [x / sum(parts) for x in parts]


def fit(patterns: list[tuple[list[int], int]], rounds: int = 5000, settled: float = 1e-9) -> Estimates:
    """Expectation maximisation over (votes, documents) counts, until no estimate moves by more than ``settled``."""
    first = now = start()
    cast_good = np.array([[v > 0 for v in votes] for votes, _ in patterns], float)
    cast_bad = np.array([[v < 0 for v in votes] for votes, _ in patterns], float)
    documents = np.array([[n] for _, n in patterns], float)
    for _ in range(rounds if patterns else 0):
        prior, bad, good = (np.array(x) for x in zip(*((c, [b for b, _ in rules], [g for _, g in rules]) for c, rules in now.odds()), strict=True))
        log = np.hstack([np.zeros_like(documents), prior + cast_bad @ bad.T + cast_good @ good.T])
        of = np.exp(log - log.max(axis=1, keepdims=True))
        of *= documents / of.sum(axis=1, keepdims=True)
        share = of.sum(axis=0) + WEIGHT * np.array(first.share)
        yes = of.T @ cast_good + WEIGHT * np.array(first.good_votes)
        rate = np.minimum(yes / (of.T @ (cast_good + cast_bad) + WEIGHT), 1 - 1e-12)
        new = Estimates((share / share.sum()).tolist(), rate.tolist())
        moved = max(np.abs(share / share.sum() - now.share).max(), np.abs(rate - now.good_votes).max())
        now = new
        if moved < settled:
            break
    return now


def posterior(vote: Column, found: Estimates) -> Column:
    """Probability that a document is good, given its votes."""
    junk = F.lit(0.0)
    for prior, rules in found.odds():
        log = F.lit(prior)
        for j, (bad, good) in enumerate(rules):
            log = log + F.when(vote[j] < 0, bad).when(vote[j] > 0, good).otherwise(0.0)
        junk = junk + F.exp(F.least(log, F.lit(700.0)))
    return 1 / (1 + junk)


def _estimates(judged: DataFrame, vote: str) -> Estimates:
    found = judged.groupBy(vote).count().collect()  # at most 3 ** len(RULES) rows
    return fit(sorted((list(r[0]), r[1]) for r in found))


def judge(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``posterior`` and ``kept`` for every row.

    The counts are made once and checkpointed (a few numbers a row, no text); fitting
    and judging read that table.
    """
    rows = counts(docs.select("doc_id", "text"))
    rows = _cuts.cut(rows.select("doc_id", *(F.col("_q_" + c).alias(c) for c in COUNTS), base_failed().alias("base_failed"), votes().alias("_v")))
    rows = rows.withColumn("posterior", posterior(F.col("_v"), _estimates(rows, "_v")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)).drop("_v")


def keep(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their columns as they were.

    The counts are made twice, for fitting and for the verdicts: writing them beside the
    texts would hold the whole table once more on disk.
    """
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names, vote = [F.col(f"`{c}`") for c in docs.columns], prefix + "votes"
    rows = counts(docs, prefix=prefix)
    found = _estimates(rows.select(votes(prefix).alias("_v")), "_v")
    made = F.struct(votes(prefix).alias(vote), base_failed(prefix).alias(prefix + "failed"))
    good = rows.select(*names, F.inline(F.array(made)))  # a generator: the filter does not make the counts again
    return good.where(~F.col(prefix + "failed") & (posterior(F.col(vote), found) >= keep_at)).select(*names)
