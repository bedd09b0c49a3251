"""Spelling variants: words at edit distance one, by rolling-hash deletions.

Two words differ by one replaced code point exactly if deleting the same place leaves
the same string, and by one inserted code point exactly if a deletion from the longer
leaves the shorter.  So a word sends one key for itself and one for each deletion:
``prefix + suffix`` sums of a polynomial hash, made for all words of a length at once.  Keys
are radix-partitioned by their upper bits; each part sorts its keys, and rows of equal keys
are told apart by the strings that are left.  A group never turns into pairs: each
member takes the group's size and its best other member, so output is linear.

A deletion within a run of equal letters leaves the same string at every place of the run,
so only the run's first place counts against shorter words; every pair is counted once.

Strings of more than ``LONG`` code points are not carried with each of their deletions, which
would cost the square of their length; a polynomial hash modulo 2**127 - 1 under a key drawn
for the run stands for them (false match below length / 2**127).

Defined cases: null text has no words; a null ``doc_id`` counts as empty text in the
deletion rule; rows that repeat id and text are counted each; ties go to the smallest
word in code-point order; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import secrets
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cuts
from . import _words as W

LONG = 64
HELD = 300_000
PRIME = (1 << 127) - 1
PART_ROWS = 200_000
KEYS = "part long, key long, at int, id long, n long, left string, check binary"


def _counts(least: int, every: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                found = Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode()))
                lead = zlib.crc32(b"%b:" % (b"" if not doc_id.is_valid else b"%d" % doc_id.as_py()))
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), lead)
                    if h % every == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield _batch(held)
                    held.clear()
        yield _batch(held)

    return run


def _batch(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, least: int = 7, seen: int = 2, every: int = 31) -> DataFrame:
    """Written (id, word, n) of the words; ids ascend in code-point order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counts(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    return _cuts.written(_cuts.written(counts).orderBy("word").withColumn("id", F.monotonically_increasing_id()))


def deletions(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length (rows of code points): keys of the words and of all their deletions."""
    m, size = points.shape
    terms = W.mix((points + 1).astype(np.uint64) * np.uint64(W.BASE)) * W.powers(W.BASE, size)
    sums = np.concatenate((np.zeros((m, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    left = sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * np.uint64(W.INVERSE)
    return W.mix(sums[:, -1].copy()), W.mix(left)


def _checks(word: str, base: int) -> tuple[int, list[int]]:
    """The word's hash modulo the prime, and those of its deletions."""
    inverse, power, sums = pow(base, -1, PRIME), 1, [0]
    for c in word:
        sums.append((sums[-1] + (ord(c) + 1) * power) % PRIME)
        power = power * base % PRIME
    return sums[-1], [(a + (sums[-1] - b) * inverse) % PRIME for a, b in zip(sums, sums[1:], strict=False)]


def _keys(parts: int, base: int):
    step = -(-(1 << 64) // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length = defaultdict(list)
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "word")), strict=True):
                by_length[len(row[2])].append(row)
            for size, rows in by_length.items():
                for i in range(0, len(rows), max(1, HELD // size)):
                    yield made(size, rows[i : i + max(1, HELD // size)])

    def made(size: int, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        points = np.frombuffer("".join(w for _, _, w in rows).encode("utf-32-le"), "<u4").reshape(len(rows), size)
        whole, less = deletions(points)
        key = np.concatenate((whole[:, None], less), axis=1).ravel()
        at = np.tile(np.arange(-1, size, dtype=np.int32), len(rows))
        left: list[str | None] = []
        check: list[bytes | None] = []
        for _, _, w in rows:
            sums = _checks(w, base) if size > LONG else (0, [])
            left += [w if size <= LONG else None, *[w if size <= LONG + 1 else None] * size]
            long = [x.to_bytes(16, "little") for x in (sums[0], *sums[1])] if sums[1] else []
            check += [long[0] if size > LONG else None, *(long[1:] if size > LONG + 1 else [None] * size)]
        first = np.ones((len(rows), size), bool)
        first[:, 1:] = points[:, 1:] != points[:, :-1]
        # a place that only repeats the letter before it is marked: it counts for replacements alone
        at = np.where(np.concatenate((np.ones((len(rows), 1), bool), first), axis=1).ravel(), at, -2 - at)
        each = lambda c: np.repeat(np.array([r[c] for r in rows], np.int64), size + 1)
        columns = [pa.array((key // np.uint64(step)).astype(np.int64)), pa.array(key.view(np.int64)), pa.array(at, pa.int32()), pa.array(each(0)), pa.array(each(1)), pa.array(left, pa.string()), pa.array(check, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "key", "at", "id", "n", "left", "check"])

    return run


def _add(out: list, members: list[tuple[int, int]]) -> None:
    """Each member (-n, id) is near all others: the best of them is the least."""
    a, b = sorted(members)[:2]
    for x in members:
        out.append((x[1], len(members) - 1, *(b if x == a else a)))


def _meet(rows: pa.Table) -> pa.Table:
    """(id, near, minus_n, form) of words that share what is left, equal ids added up later."""
    key = rows["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    start = W.heads(key[order])
    size = np.diff(np.append(start, len(key)))
    order = order[np.repeat(size > 1, size)]
    rows = rows.take(pa.array(order))
    groups: dict = defaultdict(lambda: (defaultdict(list), [], []))
    for k, at, i, n, word, check in zip(*(rows[c].to_pylist() for c in ("key", "at", "id", "n", "left", "check")), strict=True):
        place = at if at >= -1 else -2 - at
        left = check if word is None else word if at == -1 else word[:place] + word[place + 1 :]
        replaced, longer, whole = groups[k, left]
        if at == -1:
            whole.append((-n, i))
        else:
            replaced[place].append((-n, i))
            if at >= 0:
                longer.append((-n, i))
    out: list = []
    for replaced, longer, whole in groups.values():
        for members in replaced.values():
            if len(members) > 1:
                _add(out, members)
        if whole and longer:
            out.append((whole[0][1], len(longer), *min(longer)))
            out += [(i, 1, *whole[0]) for _, i in longer]
    return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("id", "near", "minus_n", "form"))})


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best: minus_n and form) of every word that has a near word."""
    rows = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(2 * _cuts.partitions(words.sparkSession), -(-rows // PART_ROWS))
    keys = words.select("id", "n", "word").mapInArrow(_keys(parts, secrets.randbits(120) + 2), KEYS)
    met = keys.groupBy("part").applyInArrow(_meet, "id long, near long, minus_n long, form long")
    return met.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "form")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root) of every word with a form, by pointer jumping; a form has ten times the count, so chains are short."""
    links = _cuts.written(links)
    while True:
        on = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = links.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = _cuts.written(step)
        links = step.select("id", "root")
        if step.where("moved").isEmpty():
            return links


def group(docs: DataFrame, least: int = 7, seen: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = vocabulary(docs, least, seen, every)
    formed = F.when(-F.col("best.minus_n") >= times * F.col("n"), F.col("best.form"))
    found = words.join(near(words), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), formed.alias("form_id"))
    found = _cuts.written(found)
    root = roots(found.where("form_id is not null").select("id", F.col("form_id").alias("root"))).withColumnRenamed("root", "root_id")
    found = found.join(root, "id", "left")
    other = lambda key, word, *more: words.select(F.col("id").alias(key), F.col("word").alias(word), *more)
    found = found.join(other("form_id", "form", F.col("n").alias("form_n")), "form_id", "left").join(other("root_id", "root_word"), "root_id", "left")
    return found.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
