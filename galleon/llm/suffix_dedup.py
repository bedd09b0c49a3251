"""Suffix-array dedup: exact repeats of byte strings across all documents.

A byte is removed where a string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller ``doc_id``, or earlier in the same document.

The corpus is split so that equal strings meet: every string belongs to the group of
its *minimizer* (the least hash among its 32-byte substrings), and consecutive strings
with one minimizer form a segment.  Groups with a single segment cannot hold a repeat
and are never shipped.  Within a target's groups, each distinct segment enters one
Burrows-Wheeler transform, whose threshold-bounded interval expansion (``bwt``) yields
the classes of equal strings; the earliest start of each class keeps its bytes.

Documents are dealt to hash blocks of about 16 MB of text.  A block sends every
minimizer, then every distinct segment, once with its first place, so a text or
passage held by a third of all documents costs one entry a block.

Defined cases: null or empty text has no bytes; texts shorter than ``length`` stay;
repeated rows (one ``doc_id``, one place) do not remove each other; a null ``doc_id``
comes after every id; an empty table gives an empty result; other columns are not
read.  Removal may split a character, so kept bytes are binary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _cuts, bwt
from . import _words as W
from .substring_dedup import _block, _deal, _read, _table, blocked, shared_anchors

UNIT = 32  # bytes hashed for minimizers


class Segments(NamedTuple):
    """Maximal runs of strings with one minimizer: first string, strings, minimizer."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    again: np.ndarray  # the minimizer comes back in the run, so it may repeat itself


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` consecutive values."""
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


def segments(t: W.Texts, length: int, unit: int) -> Segments:
    found, span = [], length - unit + 1
    for a, b in t.slices():
        lo, hi = int(t.offsets[a]), int(t.offsets[b])
        n = hi - lo
        if n < length:
            continue
        sums = W.prefix(t.data[lo:hi])
        h = sums[unit:] - sums[:-unit]
        h *= W.powers(W.INVERSE, len(h))
        h = W.mix(h)
        del sums
        low = _least(h, span)
        fits = np.zeros(n + 1, np.int32)
        size = np.diff(t.offsets[a : b + 1])
        at = (t.offsets[a:b] - lo)[size >= length]
        fits[at] += 1
        fits[at + size[size >= length] - length + 1] -= 1
        ok = np.cumsum(fits)[: len(low)] > 0
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
        new[at] = True
        back = ok & ~new & (h[span - 1 :] == low)
        start = np.flatnonzero(new)
        if not len(start):
            continue
        count = np.add.reduceat(ok.astype(np.int64), start)
        found.append((start + lo, count, low[start], np.add.reduceat(back.astype(np.int64), start) > 0))
    if not found:
        return Segments(*(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, bool)))
    return Segments(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _digest(t: W.Texts, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, which do not cross texts."""
    out = np.zeros(len(start), np.uint64)
    for a, b in t.slices():
        lo, hi = int(t.offsets[a]), int(t.offsets[b])
        x, y = np.searchsorted(start, (lo, hi))
        if x < y:
            sums, s = W.prefix(t.data[lo:hi]), start[x:y] - lo
            h = sums[s + size[x:y]] - sums[s]
            h *= W.powers(W.INVERSE, hi - lo)[s]
            h += size[x:y].astype(np.uint64)
            out[x:y] = W.mix(h)
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def find_minimizers(targets: int, length: int, unit: int):
    def run(docs: pa.Table) -> pa.Table:
        _, _, t = _read(docs)
        s = segments(t, length, unit)
        order = np.argsort(s.key, kind="stable")
        key = s.key[order]
        start = W.heads(key)
        n = np.diff(np.append(start, len(key)))
        many = (n > 1) | (np.add.reduceat(s.again[order].astype(int), start) > 0) if len(key) else n > 1
        key = key[start]
        return _table([(to, _block(docs), W.planes(key[x[~many[x]]]), W.planes(key[x[many[x]]])) for to, x in _deal(key, targets)], "_t", "_b", "one", "many")

    return run


class Distinct(NamedTuple):
    """Distinct shipped segments of a block, in the order in which they are sent."""

    places: np.ndarray  # of the segments that are shipped
    kind: np.ndarray  # number of the distinct segment, for each of them
    head: np.ndarray  # a first segment of each distinct one
    to: np.ndarray  # its target


def _distinct(t: W.Texts, s: Segments, keys: np.ndarray, targets: int, length: int) -> Distinct:
    at = np.flatnonzero(W.member(s.key, keys))
    digest = _digest(t, s.start[at], s.count[at] + length - 1)
    to = (s.key[at] % np.uint64(targets)).astype(np.int64)
    size = s.count[at] + length - 1
    order = np.lexsort((digest, size, s.key[at], to))
    key, digest, sized = s.key[at][order], digest[order], size[order]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]) | (sized[1:] != sized[:-1])
    kind = np.empty(len(at), np.int64)
    kind[order] = np.cumsum(new) - 1
    head = order[new]  # stable: the earliest of equal ones
    # digests sort, bytes decide: what differs from its head is told apart by its own bytes
    start = s.start[at]
    rest = np.setdiff1d(np.arange(len(at)), head)
    odd = [np.zeros(0, np.int64)]
    for x in np.array_split(rest, 1 + int(size[rest].sum()) // W.SLICE):
        if len(x):
            differ = t.data[_ranges(start[x], size[x])] != t.data[_ranges(start[head[kind[x]]], size[x])]
            odd.append(x[np.add.reduceat(differ, np.cumsum(size[x]) - size[x]) > 0])
    odd = np.concatenate(odd)
    if len(odd):
        known: dict[tuple[int, bytes], int] = {}
        heads = head.tolist()
        for i in odd.tolist():
            key = int(to[i]), t.data[start[i] : start[i] + size[i]].tobytes()
            if key not in known:
                known[key] = len(heads)
                heads.append(i)
            kind[i] = known[key]
        # heads by target again, in an order that depends on the segments alone
        head = np.array(heads)
        by = np.lexsort((head, to[head]))
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        head, kind = head[by], back[kind]
    return Distinct(at, kind, at[head], to[head])


def find_segments(targets: int, length: int, unit: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        names = ("_t", "_b", "keys", "counts", "ids", "places", "bytes")
        if not docs.num_rows or not shared.num_rows:
            return _table([], *names)
        _, ids, t = _read(docs)
        s = segments(t, length, unit)
        d = _distinct(t, s, np.sort(np.concatenate(W.unplanes(shared["hashes"]))), targets, length)
        of = np.searchsorted(t.offsets, s.start[d.head], "right") - 1
        place = s.start[d.head] - t.offsets[of]
        rows = []
        for x in np.split(np.arange(len(d.head)), W.heads(d.to)[1:]) if len(d.head) else []:
            h = d.head[x]
            body = t.data[_ranges(s.start[h], s.count[h] + length - 1)]
            rows.append((int(d.to[x[0]]), _block(docs), s.key[h].tobytes(), s.count[h].tobytes(), ids[of[x]].tobytes(), place[x].tobytes(), body.tobytes()))
        return _table(rows, *names)

    return run


def _i64(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int64) for x in column]


def first_starts(length: int):
    """For each block and segment sent: a bit for every string that starts nowhere earlier."""

    def run(sent: pa.Table) -> pa.Table:
        keys, blocks = sent["keys"], sent["_b"].to_pylist()
        per_row = [len(x) for x in _i64(sent["counts"])]
        count, ids, place = (np.concatenate(_i64(sent[c])) for c in ("counts", "ids", "places"))
        body = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in sent["bytes"]])
        size = count + length - 1
        ends = np.cumsum(size)
        raw, known = memoryview(body), {}
        kind = np.fromiter((known.setdefault(bytes(raw[e - n : e]), len(known)) for e, n in zip(ends, size, strict=True)), np.int64, len(size))
        _, head = np.unique(kind, return_index=True)
        del known
        # the earliest place of each distinct segment, as one integer that orders places
        u, rank = np.unique(ids, return_inverse=True)
        at = (rank.astype(np.int64) << 32) + place
        first = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(first, kind, at)
        data = body[_ranges(ends[head] - size[head], size[head])]
        order, begin = bwt.repeat_classes(data, length)
        off = np.cumsum(size[head]) - size[head]
        start = np.full(len(data), np.iinfo(np.int64).max)
        inner = _ranges(off, count[head])
        start[inner] = np.repeat(first, count[head]) + inner - np.repeat(off, count[head])
        least = np.minimum.reduceat(start[order], begin)
        best = np.empty(len(data), np.int64)
        best[order] = np.repeat(least, np.diff(np.append(begin, len(order))))
        mine = np.repeat(at - off[kind], count) + (places := _ranges(off[kind], count))
        bits = best[places] == mine
        rows, seg, n = [], 0, 0
        total = np.concatenate(([0], np.cumsum(count)))
        for b, k, m in zip(blocks, keys, per_row, strict=True):
            n = total[seg + m]
            rows.append((b, k.as_py(), np.packbits(bits[total[seg] : n]).tobytes()))
            seg += m
        return _table(rows, "_b", "keys", "bits").append_column("_t", sent["_t"].combine_chunks())

    return run


def cut_strings(targets: int, length: int, unit: int):
    def run(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        kept, n_bytes, n_removed, spans = [], [], [], []
        if docs.num_rows:
            order, ids, t = _read(docs)
            gone = np.zeros(len(t.data), bool)
            if firsts.num_rows:
                firsts = firsts.sort_by("_t")
                sent = W.u64(firsts["keys"])
                s = segments(t, length, unit)
                d = _distinct(t, s, np.unique(np.concatenate(sent)), targets, length)
                if not np.array_equal(np.concatenate(sent), s.key[d.head]):
                    raise ValueError("a block's segments differ from those it sent")
                count = s.count[d.head]
                ends, bits = np.cumsum(count), []
                parts = np.split(np.arange(len(count)), np.cumsum([len(x) for x in sent])[:-1])
                for x, b in zip(parts, firsts["bits"], strict=True):
                    bits.append(np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=int(count[x].sum())).astype(bool))
                bits = np.concatenate(bits)
                # strings of every shipped segment; the earliest place of equal segments keeps what is first
                of = np.searchsorted(t.offsets, s.start[d.places], "right") - 1
                where = s.start[d.places] - t.offsets[of]
                head = np.searchsorted(d.places, d.head)
                home = (ids[of] == ids[of][head][d.kind]) & (where == where[head][d.kind])
                n = s.count[d.places]
                first = bits[_ranges((ends - count)[d.kind], n)] & np.repeat(home, n)
                gone = W.covered(_ranges(s.start[d.places], n)[~first], length, len(t.data))
            sums = np.concatenate(([0], np.cumsum(gone)))
            lost = sums[t.offsets[1:]] - sums[t.offsets[:-1]]
            for i in range(len(ids)):
                a, b = t.offsets[i], t.offsets[i + 1]
                if not lost[i]:
                    kept.append(t.bytes(i))
                    spans.append([])
                    continue
                g = gone[a:b]
                kept.append(t.data[a:b][~g].tobytes())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            n_bytes, n_removed = np.diff(t.offsets), lost
            docs = docs.take(pa.array(order))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc_id": docs["doc_id"].cast(pa.int64()),
            "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, span),
            "kept": pa.array(kept, pa.binary()),
        })

    return run


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges) and kept bytes of every row."""
    unit = max(1, min(UNIT, length // 3))
    # a target's transform takes some hundred bytes of memory for each byte it holds
    blocks, targets = _cuts.text_blocks(docs, finer=4)
    rows = blocked(docs, blocks)
    sent = rows.groupBy("_b").applyInArrow(find_minimizers(targets, length, unit), "_t long, _b long, one binary, many binary")
    shared = sent.groupBy("_t").applyInArrow(shared_anchors, "_b long, hashes binary")
    sent = rows.groupBy("_b").cogroup(shared.groupBy("_b")).applyInArrow(
        find_segments(targets, length, unit), "_t long, _b long, keys binary, counts binary, ids binary, places binary, bytes binary"
    )
    firsts = sent.groupBy("_t").applyInArrow(first_starts(length), "_b long, keys binary, bits binary, _t long")
    return rows.groupBy("_b").cogroup(firsts.groupBy("_b")).applyInArrow(
        cut_strings(targets, length, unit), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    )
