"""Substring dedup over word windows by difference-cover anchors.

A window of 13 words that repeats elsewhere holds, whatever the two alignments, an
*aligned anchor*: some shift below the period puts both copies on positions whose
residues lie in the difference cover.  So only windows of 7 words at 3 of every 7
positions are hashed and shipped; anchors seen in one document alone end there, and
shared ones are extended to full windows, whose smallest ``doc_id`` decides.  Windows
are told apart by 128 bits under two keys drawn for the run (see ``_words``): whatever
the texts say, 10**13 windows hold a false match with a probability below 10**-7.

Documents are dealt to hash blocks of about 16 MB of text.  A block sends each anchor
(then each candidate window) once, however often the block repeats it, so a passage
held by a third of all documents costs one entry a block.  Nothing is compared pair
by pair.

Defined cases: null or empty text has no words; texts shorter than a window keep all
words; rows with the same ``doc_id`` never remove each other's words; a null
``doc_id`` comes after every id; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cuts
from . import _words as W

#: Perfect difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def period_for(window: int) -> int:
    """The largest period that leaves anchors at least half a window long."""
    return max(p for p in COVERS if 2 * p <= window + 1)


def both(t: W.Texts, keys: tuple[int, int]) -> tuple[W.Words, np.ndarray]:
    """The words with their hashes under the first key, and those under the second."""
    w = W.words(t, key=keys[0])
    return w, W.rehash(t, w, key=keys[1])


def anchors(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors at cover positions of every text."""
    p = period_for(window)
    size = window - p + 1
    at = W.whole(w, size)
    on = np.zeros(p, bool)
    on[list(COVERS[p])] = True
    at = at[on[(at - np.repeat(w.first[:-1], np.diff(w.first))[at]) % p]]
    return at, W.windows(w.hash, size)[at]


def _read(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, W.Texts]:
    """Row order by id, the ids in it, and the texts."""
    found = W.ids(docs["doc_id"])
    order = np.argsort(found, kind="stable")
    return order, found[order], W.texts(docs["text"], order)


def _deal(h: np.ndarray, targets: int) -> list[tuple[int, np.ndarray]]:
    """(target, places) of the hashes, in hash order within a target."""
    to = (h % np.uint64(targets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    at = W.heads(to[order])
    return [(int(to[x[0]]), x) for x in np.split(order, at[1:])] if len(h) else []


def _block(docs: pa.Table) -> int:
    return docs["_b"][0].as_py()


def find_anchors(targets: int, window: int, keys: tuple[int, int]):
    def run(docs: pa.Table) -> pa.Table:
        _, ids, t = _read(docs)
        w = W.words(t, key=keys[0])
        at, h = anchors(w, window)
        of = ids[w.text_of()[at]]
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        start = W.heads(h)
        many = of[start] != of[np.append(start[1:], len(h))[: len(start)] - 1] if len(h) else np.zeros(0, bool)
        h = h[start]
        rows = [(to, _block(docs), W.planes(h[x[~many[x]]]), W.planes(h[x[many[x]]])) for to, x in _deal(h, targets)]
        return _table(rows, "_t", "_b", "one", "many")

    return run


def shared_anchors(sent: pa.Table) -> pa.Table:
    """Anchors of two documents or more, sent back to each block that has them."""
    one, many, blocks = W.unplanes(sent["one"]), W.unplanes(sent["many"]), sent["_b"].to_pylist()
    lone = np.concatenate(one)
    u, n = np.unique(lone, return_counts=True) if len(lone) else (lone, np.zeros(0, int))
    twice = np.unique(np.concatenate([u[n > 1], *many]))
    rows = []
    for b, x, y in zip(blocks, one, many, strict=True):
        back = np.concatenate([x[W.member(x, twice)], y])
        if len(back):
            rows.append((b, W.planes(back)))
    return _table(rows, "_b", "hashes")


def find_windows(targets: int, window: int, keys: tuple[int, int]):
    p = period_for(window)

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return _table([], "_t", "_b", "hashes", "checks", "ids")
        _, ids, t = _read(docs)
        w, second = both(t, keys)
        at, h = anchors(w, window)
        at = at[W.member(h, np.sort(np.concatenate(W.unplanes(shared["hashes"]))))]
        first = np.repeat(w.first[:-1], np.diff(w.first))[at]
        lo, hi = np.maximum(at - p + 1, first), np.minimum(at, w.stop()[at] - window)
        ok = lo <= hi
        at = np.flatnonzero(W.covered(lo[ok], hi[ok] - lo[ok] + 1, len(w.hash)))
        h, g, of = W.windows(w.hash, window)[at], W.windows(second, window)[at], ids[w.text_of()[at]]
        order, start = W.order2(h, g)
        first = order[start]
        h, g, of = h[first], g[first], of[first]
        rows = [(to, _block(docs), W.planes(h[x]), W.planes(g[x]), W.planes(of[x])) for to, x in _deal(h, targets)]
        return _table(rows, "_t", "_b", "hashes", "checks", "ids")

    return run


def first_windows(sent: pa.Table) -> pa.Table:
    """For each block, the windows that start in an earlier document of another block."""
    hs, blocks = W.unplanes(sent["hashes"]), sent["_b"].to_pylist()
    of = np.concatenate(W.unplanes(sent["ids"], np.int64))
    h, g, row = np.concatenate(hs), np.concatenate(W.unplanes(sent["checks"])), np.repeat(np.arange(len(hs)), [len(x) for x in hs])
    order, start = W.order2(h, g)
    h, g, of, row = h[order], g[order], of[order], row[order]
    least = np.repeat(np.minimum.reduceat(of, start), np.diff(np.append(start, len(h)))) if len(h) else of
    late = np.flatnonzero(of > least)
    late = late[np.argsort(row[late], kind="stable")]
    at = W.heads(row[late])
    parts = np.split(late, at[1:]) if len(late) else []
    return _table([(blocks[row[x[0]]], W.planes(h[x]), W.planes(g[x]), W.planes(least[x])) for x in parts], "_b", "hashes", "checks", "ids")


def cut_windows(window: int, keys: tuple[int, int]):
    def run(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        kept, n_words, n_removed = [], [], []
        if docs.num_rows:
            order, ids, t = _read(docs)
            w, second = both(t, keys)
            at = W.whole(w, window)
            h, g, of = W.windows(w.hash, window)[at], W.windows(second, window)[at], ids[w.text_of()[at]]
            by, start = W.order2(h, g)
            first = by[start]
            least = of[first]
            if firsts.num_rows:
                fh, fg = (np.concatenate(W.unplanes(firsts[c])) for c in ("hashes", "checks"))
                fi = np.concatenate(W.unplanes(firsts["ids"], np.int64))
                x = W.find2(h[first], g[first], fh, fg)
                least[x] = np.minimum(least[x], fi)
            late = np.empty(len(h), bool)
            late[by] = of[by] > np.repeat(least, np.diff(np.append(start, len(h))))
            gone = W.covered(at[late], window, len(w.hash))
            sums = np.concatenate(([0], np.cumsum(gone)))
            lost = sums[w.first[1:]] - sums[w.first[:-1]]
            for i in range(len(ids)):
                found = t.bytes(i).split()
                if lost[i]:
                    found = [found[j] for j in np.flatnonzero(~gone[w.first[i] : w.first[i + 1]])]
                kept.append(b" ".join(found))
            n_words, n_removed = np.diff(w.first), lost
            docs = docs.take(pa.array(order))
        return pa.table({
            "doc_id": docs["doc_id"].cast(pa.int64()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return run


def _table(rows: list[tuple], *names: str) -> pa.Table:
    kinds = {"_t": pa.int64(), "_b": pa.int64()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds.get(n, pa.binary())) for i, n in enumerate(names)})


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text and the hash block that a row belongs to."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.pmod(key, F.lit(blocks)).alias("_b"))


def deduplicate(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row."""
    blocks, keys = _cuts.text_blocks(docs), (W.new_key(), W.new_key())
    rows = blocked(docs, blocks)
    sent = rows.groupBy("_b").applyInArrow(find_anchors(blocks, window, keys), "_t long, _b long, one binary, many binary")
    shared = sent.groupBy("_t").applyInArrow(shared_anchors, "_b long, hashes binary")
    sent = rows.groupBy("_b").cogroup(shared.groupBy("_b")).applyInArrow(find_windows(blocks, window, keys), "_t long, _b long, hashes binary, checks binary, ids binary")
    firsts = sent.groupBy("_t").applyInArrow(first_windows, "_b long, hashes binary, checks binary, ids binary")
    return rows.groupBy("_b").cogroup(firsts.groupBy("_b")).applyInArrow(cut_windows(window, keys), "doc_id long, n_words long, n_removed long, kept_text string")
