"""Benchmark decontamination by CGK embeddings, bit sampling and exact edit distances.

A document is contaminated by an item where some stretch of its words is within
``edits`` (a part of the item's words) word edits of the item, A-Z lower-cased.

The CGK random walk reads a word sequence step by step: at step ``j`` it writes the word
it stands on and moves on or stays by a random bit of (``j``, word), so sequences a few
edits apart write nearly the same string, and edit distance becomes Hamming distance.
Every word of a document starts an item-sized window; the walks of all windows advance
together.  ``WALKS`` walks times ``tables`` samples of ``SAMPLE`` steps make the hash
tables of a length class; a window that agrees with an item in one table is a
candidate, and the edit distance around it decides, exactly, by bit-parallel dynamic
programming.  Items of twice ``PIECE`` words and more are looked for by their pieces of ``PIECE`` words:
walks drift apart with every edit, more so where all edits are of one kind, but some
piece has no more than its share of the edits, and each begins walks of its own.  Items for which no edit is allowed are found by the hash of their words,
which misses none.

The benchmark is a stated query set: it is read in blocks of at most ``block_bytes`` of
text, each sent to the tasks whole, and documents are read once a block without any
shuffle.

Defined cases: null or empty texts and items without words match nothing; items or
documents with null ids are reported with null ids; repeated rows are reported each;
empty tables give an empty result; no other column is read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

WALKS, TABLES, SAMPLE = 4, 4, 3
EDITS = 0.15
PIECE = 64
#: Tables whose keys are held at once.
HELD = 32
SMALL = 1 << 16
FOLD = np.uint32(0x9E3779B1)


class Group(NamedTuple):
    """Pieces of one length class: steps sampled by each table, and the pieces' keys."""

    steps: list[list[list[int]]]  # by walk, by table
    keys: list[list[np.ndarray]]  # sorted
    pieces: list[list[np.ndarray]]  # in the keys' order
    maybe: list[list[np.ndarray]]  # which low bits of keys occur


class Queries(NamedTuple):
    """A block of items, ready for search."""

    ids: list
    words: list[tuple[int, ...]]
    allowed: list[int]
    piece_of: np.ndarray  # the item of every piece
    offset: np.ndarray  # and where in it the piece begins
    groups: list[Group]
    exact: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes, pieces


class Laid(NamedTuple):
    """Words of many texts in a row, with a blank after each text on which walks stay."""

    hash: np.ndarray
    blank: np.ndarray
    symbol: np.ndarray  # 32 bits of the word
    place: np.ndarray  # of every word


def lay(w: W.Words) -> Laid:
    place = np.arange(len(w.hash)) + w.text_of()
    h = np.zeros(len(w.hash) + len(w.first) - 1, np.uint64)
    h[place] = w.hash
    blank = np.ones(len(h), bool)
    blank[place] = False
    symbol = (h >> np.uint64(32)).astype(np.uint32)
    symbol[blank] = 1
    return Laid(h, blank, symbol, place.astype(np.int32))


def walk_keys(text: Laid, start: np.ndarray, walk: int, steps: list[list[int]]) -> list[np.ndarray]:
    """For each table, the sampled steps of the embeddings that begin at ``start``, folded to 32 bits.

    At step ``j`` every walk writes the word under it, then moves on by bit ``j`` of that
    word's random mask; all walks of a kind advance together.
    """
    keys, wanted = [np.zeros(len(start), np.uint32) for _ in steps], defaultdict(list)
    for key, at in zip(keys, steps, strict=True):
        for j in at:
            wanted[j].append(key)
    at, here = start.copy(), np.empty(len(start), np.uint32)
    for j in range(max(wanted, default=-1) + 1):
        if j % 32 == 0:
            salt = np.uint64(((walk * 64 + j // 32 + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
            bits = (W.mix(text.hash ^ salt) >> np.uint64(32)).astype(np.uint32)
            bits[text.blank] = 0
        if j in wanted:
            np.take(text.symbol, at, out=here, mode="clip")
            for key in wanted[j]:
                key *= FOLD
                key += here
        np.take(bits, at, out=here, mode="clip")
        here >>= np.uint32(j % 32)
        here &= np.uint32(1)
        at += here.view(np.int32)
    for key in keys:
        key *= FOLD
        key ^= key >> np.uint32(15)
    return keys


def tables(length: int) -> int:
    """Tables of each walk for the class of ``length`` words and more: edits grow with the
    pieces and walks drift apart, so long ones agree in a smaller part of their tables."""
    return max(TABLES, length // 4 if length >= 64 else 0)


def offsets(n: int) -> list[int]:
    """Where the pieces of an item of ``n`` words begin: at its start alone, or everywhere in steps of a piece."""
    return [0] if n < 2 * PIECE else [*range(0, n - PIECE, PIECE), n - PIECE]


def _plan(length: int, walk: int, seed: int) -> list[list[int]]:
    """Steps sampled by each table from the embedding of ``length`` words and more."""
    r = np.random.default_rng([seed, length, walk])
    return [sorted(int(x) for x in r.choice(2 * length - 1, SAMPLE, replace=False)) for _ in range(tables(length))]


def prepare(items: list[tuple[int | None, str | None]], edits: float = EDITS, seed: int = 0) -> Queries:
    t = W.texts(pa.array([x for _, x in items], pa.string()))
    w = W.words(t, lower=True)
    n = np.diff(w.first)
    allowed = [int(edits * x + 1e-9) for x in n]
    begins = [offsets(int(x)) if x else [] for x in n]
    piece_of, offset = np.repeat(np.arange(len(n)), [len(x) for x in begins]), np.array([o for x in begins for o in x], np.int64)
    size = np.where(n[piece_of] < 2 * PIECE, n[piece_of], PIECE)
    exact, groups, edited = {}, [], np.array(allowed, np.int64)[piece_of] > 0
    for length in sorted(set(size[~edited].tolist())):
        of = np.flatnonzero(~edited & (size == length))
        first = w.first[piece_of[of]]
        h = np.array([W.windows(w.hash[a : a + length], length)[0] for a in first])
        order = np.argsort(h)
        exact[length] = h[order], of[order]
    laid, classes = lay(w), defaultdict(list)
    for i in np.flatnonzero(edited).tolist():
        classes[1 << (int(size[i]).bit_length() - 1)].append(i)
    for length, of in sorted(classes.items()):
        steps = [_plan(length, k, seed) for k in range(WALKS)]
        first = laid.place[w.first[piece_of[of]] + offset[of]]
        packed = [walk_keys(laid, first, k, steps[k]) for k in range(WALKS)]
        order = [[np.argsort(x, kind="stable") for x in row] for row in packed]
        maybe = [[np.isin(np.arange(SMALL), x % np.uint32(SMALL)) for x in row] for row in packed]
        groups.append(Group(steps, [[x[o] for x, o in zip(p, q, strict=True)] for p, q in zip(packed, order, strict=True)], [[np.array(of)[o] for o in q] for q in order], maybe))
    words = [tuple(map(int, w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return Queries([i for i, _ in items], words, allowed, piece_of, offset, groups, exact)


def candidates(w: W.Words, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece) of windows that agree with a piece of an item in some table."""
    found, text = [np.zeros(0, np.int64)], lay(w)
    k = max(1, len(q.piece_of))
    for size, (h, of) in q.exact.items():
        at = W.whole(w, size)
        x = W.windows(w.hash, size)[at]
        hit = W.member(x, h)
        for p, v in zip(at[hit], x[hit], strict=True):
            a, b = np.searchsorted(h, v, "left"), np.searchsorted(h, v, "right")
            found.append(p * k + of[a:b])
    if not len(w.hash):
        return found[0], found[0]
    for walk in range(WALKS):
        todo = [(g, t) for g in q.groups for t in range(len(g.steps[walk]))]
        for part in (todo[i : i + HELD] for i in range(0, len(todo), HELD)):
            keys = walk_keys(text, text.place, walk, [g.steps[walk][t] for g, t in part])
            for (g, t), key in zip(part, keys, strict=True):
                at = np.flatnonzero(g.maybe[walk][t][key & np.uint32(SMALL - 1)])
                lo = np.searchsorted(g.keys[walk][t], key[at], "left")
                n = np.searchsorted(g.keys[walk][t], key[at], "right") - lo
                which = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
                found.append(np.repeat(at, n) * k + g.pieces[walk][t][which])
    pair = np.unique(np.concatenate(found))
    return pair // k, pair % k


def reach(q: Queries, at: np.ndarray, piece: np.ndarray, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item of every candidate, and the words [lo, hi) of its text within which the item lies if the piece lies there.

    A piece that is not the item's start may also stand off by the edits before it.
    """
    item, offset = q.piece_of[piece], q.offset[piece]
    n, k = np.array([len(x) for x in q.words], np.int64)[item], np.array(q.allowed, np.int64)[item]
    doc = np.searchsorted(w.first, at, "right") - 1
    more = np.where(offset > 0, k, 0)
    lo, hi = at - offset - k - more, at - offset + n + 2 * k + more
    return item, np.maximum(lo, w.first[doc]), np.minimum(hi, w.first[doc + 1])


def plausible(w: W.Words, q: Queries, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the candidates around which enough words are words of the item.

    Within ``k`` edits all but ``k`` of an item's words are there, so nothing near is
    lost; windows that agree by common words alone mostly are.
    """
    ok = np.zeros(len(item), bool)
    low = (w.hash & np.uint64(SMALL - 1)).astype(np.int64)
    order = np.argsort(item, kind="stable")
    for x in np.split(order, W.heads(item[order])[1:]) if len(item) else []:
        i = int(item[x[0]])
        inside = np.zeros(SMALL, bool)
        inside[[h & (SMALL - 1) for h in q.words[i]]] = True
        sums = np.concatenate(([0], np.cumsum(inside[low])))
        ok[x] = sums[hi[x]] - sums[lo[x]] >= len(q.words[i]) - q.allowed[i]
    return ok


def nearest(item: tuple[int, ...], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to a stretch of the text, and where the first such stretch ends.

    Myers' bit-parallel search, over words.
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, x in enumerate(item):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, x in enumerate(text):
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = score, j + 1
    return best


def merged(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(doc, item, lo, hi) of the unions of overlapping stretches, in order of place."""
    last: tuple | None = None
    order = np.lexsort((hi, lo, item, doc))
    for d, i, a, b in zip(*(x[order].tolist() for x in (doc, item, lo, hi)), strict=True):
        if last and last[:2] == (d, i) and a <= last[3]:
            last = (d, i, last[2], max(b, last[3]))
        else:
            if last:
                yield last
            last = (d, i, a, b)
    if last:
        yield last


def _search(q: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = pa.table(batch), []
            whole = W.texts(rows["text"])
            ids = rows["doc_id"].to_pylist()
            for a, b in whole.slices(1 << 20):
                t = W.Texts(whole.data[whole.offsets[a] : whole.offsets[b]], whole.offsets[a : b + 1] - whole.offsets[a])
                w = W.words(t, lower=True)
                at, piece = candidates(w, q)
                item, lo, hi = reach(q, at, piece, w)
                ok = plausible(w, q, item, lo, hi)
                item, lo, hi = item[ok], lo[ok], hi[ok]
                doc = np.searchsorted(w.first, at[ok], "right") - 1
                best: dict[tuple[int, int], tuple] = {}
                # stretches that overlap are searched as one, so the distance is the least around all candidates
                for d, i, p, e in merged(doc, item, lo, hi):
                    if best.get((d, i), (1,))[0] == 0:
                        continue
                    text = w.hash[p:e].tolist()
                    far, end = nearest(q.words[i], text)
                    if far <= q.allowed[i] and ((d, i) not in best or far < best[d, i][0]):
                        _, size = nearest(q.words[i][::-1], text[:end][::-1])
                        start = p + end - (size if size else len(q.words[i])) - int(w.first[d])
                        best[d, i] = far, start, p + end - int(w.first[d])
                out += [(ids[a + d], q.ids[i], *x, len(q.words[i])) for (d, i), x in sorted(best.items())]
            names = ("doc_id", "item_id", "distance", "start_word", "end_word", "item_words")
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(names)})

    return run


def blocks_of(benchmark: DataFrame, block_bytes: int = 8 << 20) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items with words, in blocks of about ``block_bytes`` of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, seed: int = 0) -> DataFrame:
    """doc_id, item_id, distance (word edits), start_word, end_word and item_words of every
    document and item that come within ``edits`` of each other."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, distance long, start_word long, end_word long, item_words long"
    out = docs.sparkSession.createDataFrame([], kind)
    for block in blocks_of(benchmark):
        out = out.union(rows.mapInArrow(_search(prepare(block, edits, seed)), kind))
    return out


def _clean(q: Queries, text: str):
    search = _search(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(batch.num_rows), pa.int64()), "text": batch.column(text)})
            bad = next(search(iter([numbered]))).column("doc_id").to_numpy()
            ok = np.ones(batch.num_rows, bool)
            ok[bad] = False
            yield batch.filter(pa.array(ok)).select([c for c in batch.schema.names if c != text])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, seed: int = 0) -> DataFrame:
    """The documents that no item contaminates, with their columns as they were."""
    name = "_text"
    while name in map(str.lower, docs.columns):
        name = "_" + name
    for block in blocks_of(benchmark):
        docs = docs.withColumn(name, F.col("text").cast("string")).mapInArrow(_clean(prepare(block, edits, seed), name), docs.schema)
    return docs
