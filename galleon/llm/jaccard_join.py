"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles.  Each shingle flips one bit of a
(sparse, very long) parity sketch, so the Hamming distance of two sketches never
exceeds the symmetric difference of the sets.  Similarity t bounds that difference by
``(1 - t) / (1 + t)`` of the summed sizes.  Sizes fall into bands; a band's sketch is
cut into more parts than its largest difference, so two similar documents agree on a
non-empty part (pigeonhole).  A document with too many empty parts to be sure of that
is sketched again under further seeds until it is.  Documents meet where a part agrees;
within such a run only a star from its least document is proposed, then, where a run
still spans several components, the pairs between components whose dense sketches are
near enough.  Every proposed pair is verified on the sets themselves; links between
documents of one component need no look.

A phrase in very many documents makes long runs.  A part that so many share is set
aside for every document that agrees with its likes elsewhere in any case, because it
has more filled parts than differences allowed and such parts together; only documents
without that surplus are compared there, in chunks of bounded size.

Documents with equal sets collapse to the least ``doc_id`` first, in every slice of
text, and a set that very many share is looked up in a table of at most ``1 / HOT_SHARE``
rows.  Part keys travel as packed arrays, one a slice of text and target.  Shingles are
told apart by 64 bits within a pair and sets by 128 bits, under keys drawn for the run
(see ``_words``): no text can be written to collide, and by chance two documents of
20,000 words are misjudged with a probability below 10**-8.

Similarities of 0.6 and more can be asked for; others raise ``ValueError``, as small sets would not agree on any part.

Defined cases: fewer than five words: the whole sequence is the one shingle; no words
or null text: the empty set, linked with nothing; rows without ``doc_id`` link with
nothing and have no component; rows that repeat a ``doc_id`` are one document, linked
through any of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _cuts
from . import _words as W
from .components import components

RATIO = 1.7  # between the edges of size bands, or a little more than sizes of linked sets may differ
SEEDS = 64
SURPLUS = 1.2  # filled parts for each difference allowed, on average
HOT = 1000  # documents of a run from which its part is set aside
CHUNK = 4096  # documents of a run that are compared at once
HOT_SHARE = 0.001  # part of all documents from which a set is hot


class Bound:
    """Integer arithmetic of a similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        if not 0 < 6 * den <= 10 * num <= 10 * den:
            raise ValueError("the similarity must be from 0.6 to 1")
        self.num, self.den = num, den
        self.edges, ratio = [1], max(RATIO, 1.05 * den / num)
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(np.ceil(self.edges[-1] * ratio))))
        self.edges = np.array(self.edges)
        top = self.edges[1:] - 1
        differ = self.differ(2 * top)
        # parts a member, of which exp(-1 / parts) stay empty
        share = SURPLUS * 2 * (den - num) / (den + num)
        parts = share
        while parts and parts * (1 - np.exp(-1 / parts)) < share:
            parts *= 1.01
        self.parts = np.where(differ == 0, 1, np.maximum(differ + 1, np.ceil(parts * top).astype(np.int64) + 2))

    def differ(self, sizes: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of two linked sets whose sizes sum to ``sizes``."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def largest(self, n: np.ndarray) -> np.ndarray:
        """Size of the largest set that can link with one of size ``n``."""
        return n * self.den // self.num


def _sequence(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, told apart from shingles of k words by its length."""
    x = len(h)
    for v in h.tolist():
        x = (x * int(W.STEP) + v) & ((1 << 64) - 1)
    return np.uint64(x)


def shingle_sets(t: W.Texts, k: int, keys: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of every text under the first key, those under further
    keys beside them, and where each text's begin."""
    w = W.words(t, lower=True, key=keys[0])
    n = np.diff(w.first)
    at = W.whole(w, k)
    words = [w.hash, *(W.rehash(t, w, lower=True, key=key) for key in keys[1:])]
    hashes = [W.windows(x, k)[at] for x in words]
    size = np.maximum(0, n - k + 1)
    ends = np.cumsum(size)
    for a, b in zip(ends - size, ends, strict=True):
        if b - a > 1:
            if len(hashes) == 1:
                hashes[0][a:b].sort()
            else:
                order = np.argsort(hashes[0][a:b])
                for h in hashes:
                    h[a:b] = h[a:b][order]
    new = np.ones(len(at), bool)
    new[1:] = hashes[0][1:] != hashes[0][:-1]
    new[(ends - size)[size > 0]] = True
    count = np.add.reduceat(np.append(new, False), np.minimum(ends - size, len(new))) * (size > 0) if len(size) else size
    hashes = [h[new] for h in hashes]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        count = count.copy()
        places = np.cumsum(count)[short] - count[short]
        for i, x in enumerate(words):
            one = np.array([_sequence(x[w.first[d] : w.first[d + 1]]) for d in short], np.uint64)
            hashes[i] = np.insert(hashes[i], places, W.mix(one))
        count[short] = 1
    return hashes, np.concatenate(([0], np.cumsum(count)))


def part_keys(h: np.ndarray, first: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key) of the sketch parts through which the texts can meet, and each text's surplus
    of filled parts under the first seed, for even and odd bands.

    The lowest bit of a key is its band's, the next is set under further seeds.
    """
    n = np.diff(first)
    band = np.searchsorted(bound.edges, n, "right") - 1
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    surplus = np.full((len(n), 2), -1)
    for up in (0, 1):
        group = band + up
        live = np.flatnonzero((n > 0) & ((bound.largest(n) >= bound.edges[group]) | (up == 0)))
        top = bound.edges[group + 1] - 1
        need = bound.differ(n + np.minimum(top, bound.largest(n))) + 1
        for seed in range(SEEDS):
            if not len(live):
                break
            size = n[live]
            ends = np.cumsum(size)
            x = h[np.arange(ends[-1]) + np.repeat(first[live] - ends + size, size)]
            own = np.repeat(np.arange(len(live)), size)
            if seed:
                x = W.mix(x + np.uint64(seed) * W.STEP)
            part = ((x >> np.uint64(32)) * bound.parts[group[live]].astype(np.uint64)[own]) >> np.uint64(32)
            if seed:
                order = np.lexsort((part, own))
                x, part = x[order], part[order]
            new = np.ones(len(x), bool)
            new[1:] = (part[1:] != part[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(new)
            key = np.bitwise_xor.reduceat(W.mix(x >> np.uint64(20)), at)
            of = live[own[at]]
            key += part[at] * W.STEP + group[of].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed)
            key = W.mix(key) & ~np.uint64(3)
            key |= (group[of] & 1).astype(np.uint64) | np.uint64(2 if seed else 0)
            out.append((of, key))
            filled = np.bincount(own[at], minlength=len(live))
            if not seed:
                surplus[live, group[live] & 1] = filled - need[live]
            live = live[filled < need[live]]
        if len(live):
            raise RuntimeError("no seed spreads a document's shingles over enough parts")
    return np.concatenate([o for o, _ in out]), np.concatenate([k for _, k in out]), surplus


def _batches(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[pa.Table, W.Texts]]:
    for batch in batches:
        whole = pa.table(batch)
        sizes = W.texts(whole["text"])
        for a, b in sizes.slices(limit):
            part = whole.slice(a, b - a)
            yield part, W.texts(part["text"])


def send_parts(targets: int, k: int, bound: Bound, keys: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (rows, t) in enumerate(_batches(batches)):
            ids = W.ids(rows["doc_id"])
            (h, g), first = shingle_sets(t, k, keys)
            n = np.diff(first)
            sig, check = (_total(W.mix(x + np.uint64(7)), first) + n.astype(np.uint64) for x in (h, g))
            of, key, surplus = part_keys(h, first, bound)
            # of the documents with one set, the least speaks for all
            order = np.lexsort((ids, check, sig))
            lead = np.ones(len(ids), bool)
            lead[order[1:]] = (sig[order[1:]] != sig[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            lead &= ids != W.NO_ID
            of, key = of[lead[of]], key[lead[of]]
            to = ((key >> np.uint64(2)) % np.uint64(targets)).astype(np.int64)
            order = np.lexsort((of, to))
            of, key, to = of[order], key[order], to[order]
            out = []
            for x in np.split(np.arange(len(to)), W.heads(to)[1:]) if len(to) else []:
                start = W.heads(of[x])
                d = of[x][start]
                out.append((int(to[x[0]]), key[x].tobytes(), np.diff(np.append(start, len(x))).tobytes(), ids[d].tobytes(), sig[d].tobytes(), None, None))
            nulls = rows["doc_id"].is_null().to_numpy()
            dense = b"".join(sketch(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True))
            about = np.column_stack([n, check.view(np.int64), surplus]).astype(np.int64)
            out.append((number % targets, dense, None, ids.tobytes(), sig.tobytes(), about.tobytes(), nulls.tobytes()))
            names = ("_t", "keys", "counts", "ids", "sigs", "about", "nulls")
            yield from pa.table({c: pa.array([r[i] for r in out], pa.int64() if c == "_t" else pa.binary()) for i, c in enumerate(names)}).to_batches()

    return run


def _total(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``x`` that begin at ``first``."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    return sums[first[1:]] - sums[first[:-1]]


DOC, PAIR, RUN, HOT_PART = 0, 1, 2, 3
MET = "kind byte, x long, y long, sig long, check long, even long, odd long, nil boolean, sketch binary"


def _met(kind: int, x: np.ndarray, y: np.ndarray, **more) -> pa.Table:
    made = {"kind": np.full(len(x), kind, np.int8), "x": x, "y": y}
    made |= {c: more.get(c, np.zeros(len(x), np.int64)) for c in ("sig", "check", "even", "odd")}
    made |= {"nil": more.get("nil", np.zeros(len(x), bool)), "sketch": pa.array(more.get("sketch", [None] * len(x)), pa.binary())}
    return pa.table(made)


def meet(sent: pa.Table, hot_size: int) -> pa.Table:
    """Of a target's parts: every document's size and sketch, stars of the runs, runs of three
    sets or more (``even``: whether hot, ``odd``: the band's bit), and who is in hot runs of the first seed."""
    docs, out = sent.filter(sent["about"].is_valid()), [_met(DOC, *np.zeros((2, 0), np.int64))]
    for i, s, a, z, dense in zip(docs["ids"], docs["sigs"], docs["about"], docs["nulls"], docs["keys"], strict=True):
        of = np.frombuffer(i.as_py(), np.int64)
        size, check, even, odd = np.frombuffer(a.as_py(), np.int64).reshape(-1, 4).T
        ends = np.cumsum([sketch_bits(x) // 8 for x in size])
        dense = dense.as_py()
        cut = [dense[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        nil = np.frombuffer(z.as_py(), bool)
        out.append(_met(DOC, of, np.ascontiguousarray(size), sig=np.frombuffer(s.as_py(), np.int64), check=check, even=even, odd=odd, nil=nil, sketch=cut))
    parts = sent.filter(sent["about"].is_null())
    if parts.num_rows:
        key = np.concatenate(W.u64(parts["keys"]))
        count = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in parts["counts"]])
        ids = np.repeat(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in parts["ids"]]), count)
        sig = np.repeat(np.concatenate(W.u64(parts["sigs"])), count)
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = W.heads(key)
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        many = np.bincount(run, minlength=len(start))[run] > 1
        order, run = order[many], run[many]
        ids, sig, key = ids[order], sig[order], key[many]
        # one document, the least, for each distinct set of a run
        order = np.lexsort((ids, sig, run))
        run, ids, sig, key = run[order], ids[order], sig[order], key[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (sig[1:] != sig[:-1])
        order = np.lexsort((ids[new], run[new]))
        run, ids, key = run[new][order], ids[new][order], key[new][order]
        start = W.heads(run)
        size = np.diff(np.append(start, len(run)))
        lead = np.repeat(ids[start], size) if len(run) else ids
        star = lead != ids
        pair = np.unique(np.stack([lead[star], ids[star]]), axis=1)
        out.append(_met(PAIR, pair[0], pair[1]))
        odd, later = (key & np.uint64(1)).astype(np.int64), (key & np.uint64(2)) > 0
        hot = np.repeat(size > hot_size, size)
        out.append(_met(HOT_PART, ids[hot & ~later], odd[hot & ~later]))
        # runs with the same documents say the same
        of = W.mix(ids.astype(np.uint64) + np.where(hot, odd + 1, 0).astype(np.uint64) * W.STEP)
        what = _total(of, np.append(start, len(run))) if len(run) else np.zeros(0, np.uint64)
        first = np.zeros(len(start), bool)
        first[np.unique(what, return_index=True)[1]] = True
        rows = np.repeat((size > 2) & first, size)
        out.append(_met(RUN, np.repeat(what, size)[rows].view(np.int64), ids[rows], even=hot[rows].astype(np.int64), odd=odd[rows]))
    return pa.concat_tables(out)


def _meet(hot_size: int):
    return lambda sent: meet(sent, hot_size)


def sets_of(k: int, keys: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in _batches(batches):
            (h,), first = shingle_sets(t, k, keys[:1])
            sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
            yield from pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), "set": sets}).to_batches()

    return run


def sketch_bits(n: int) -> int:
    """Bits of the dense sketch of ``n`` members: two to four each."""
    return max(256, 1 << int(2 * n - 1).bit_length()) if n else 256


def sketch(s: np.ndarray) -> np.ndarray:
    """Dense parity sketch of a set, as 64-bit words."""
    bits = sketch_bits(len(s))
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool), bitorder="little").view(np.uint64)


def fold(s: np.ndarray, n: int) -> np.ndarray:
    """The sketch of ``n`` words of the same set; distances still bound from below."""
    while len(s) > n:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def _words(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def near(bound: Bound):
    """Of pairs with both sketches: those whose distance and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            far = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(_words(batch.column("sa")), _words(batch.column("sb")), strict=True)):
                k = min(len(x), len(y))
                far[i] = np.bitwise_count(fold(x, k) ^ fold(y, k)).sum()
            ok = (far <= bound.differ(n + m)) & (bound.largest(np.minimum(n, m)) >= np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in "ab"], ["a", "b"])

    return run


def between(bound: Bound):
    """Pairs of a run's documents, of different components, whose sketches are near enough.

    A run comes whole, or as two of its chunks: ``part`` 0 and 1 are then compared with each other.
    """

    def run(rows: pa.Table) -> pa.Table:
        run, i1, i2, part, ids, comp, size = (rows[c].to_numpy() for c in ("run", "i", "j", "part", "doc_id", "component", "n"))
        dense = _words(rows["sketch"])
        order = np.lexsort((part, i2, i1, run))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (run, i1, i2)], axis=0)
        out = [np.zeros((2, 0), np.int64)]
        for x in np.split(order, np.flatnonzero(new)[1:]):
            least = min(len(dense[i]) for i in x)
            sk = np.stack([fold(dense[i], least) for i in x])
            n, c, d = size[x], comp[x], ids[x]
            cross = int((part[x] == 0).sum()) if i1[x[0]] != i2[x[0]] else 0
            for i in range(cross or len(x) - 1):
                at = cross or i + 1
                j = at + np.flatnonzero(c[at:] != c[i])
                j = j[bound.largest(np.minimum(n[i], n[j])) >= np.maximum(n[i], n[j])]
                far = np.bitwise_count(sk[j] ^ sk[i]).sum(axis=1)
                j = j[far <= bound.differ(n[i] + n[j])]
                out.append(np.stack([np.minimum(d[i], d[j]), np.maximum(d[i], d[j])]))
        pair = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": pair[0], "b": pair[1]})

    return run


def _chunked(member: DataFrame) -> DataFrame:
    """The members of runs (with the run's ``size``), once for each pair of chunks that theirs belongs to."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), chunks).cast("int")
    rows = member.withColumn("chunks", chunks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("part"))


def _verified(pairs: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """The pairs (a, b) whose sets link, decided on the sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = both.select("a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b")).alias("n"))
    return both.where(F.col("i") * bound.den >= (F.col("n") - F.col("i")) * bound.num).select("a", "b").distinct()


def _sets(rows: DataFrame, pairs: DataFrame, k: int, keys: tuple[int, int]) -> DataFrame:
    """The sets of the documents in the pairs."""
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return _cuts.written(rows.join(need, "doc_id", "left_semi").mapInArrow(sets_of(k, keys), "doc_id long, set array<long>"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    end = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    rows = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return rows.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def link(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles and component_id of every row; verified links
    (a, b) between documents with different sets that span the components."""
    bound, spark, keys = Bound(num, den), docs.sparkSession, (W.new_key(), W.new_key())
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    targets = _cuts.text_blocks(rows)
    sent = rows.mapInArrow(send_parts(targets, k, bound, keys), "_t long, keys binary, counts binary, ids binary, sigs binary, about binary, nulls binary")
    met = _cuts.written(sent.groupBy("_t").applyInArrow(_meet(HOT), MET))
    every = met.where(F.col("kind") == DOC).select(F.col("x").alias("doc_id"), F.col("y").alias("n_shingles"), "sig", "check", "nil")
    dense = met.where((F.col("kind") == DOC) & ~F.col("nil")).select(F.col("x").alias("id"), F.col("y").alias("n"), "sketch")
    pairs = met.where(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    side = lambda c: dense.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
    pairs = _cuts.written(pairs.mapInArrow(near(bound), "a long, b long").distinct())
    # one leader for each document first, then what that leaves apart
    sets = _sets(rows, pairs, k, keys)
    first = _cuts.written(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, bound))
    early = components(first)
    links = _cuts.written(first.union(_verified(_apart(pairs, early), sets, bound)))
    _cuts.drop(sets, pairs, first, early)
    label = components(links)
    members, made = _members(met, label, dense)
    found = _cuts.written(members.groupBy("_g").applyInArrow(between(bound), "a long, b long").distinct())
    every, all_met = _cuts.written(every), met
    _cuts.drop(*made, all_met)
    if not found.isEmpty():
        sets = _sets(rows, found, k, keys)
        before, links = links, _cuts.written(links.union(_verified(found, sets, bound)))
        _cuts.drop(sets, before, label)
        label = components(links)
    _cuts.drop(found)
    home = _homes(every.where(~F.col("nil") & (F.col("n_shingles") > 0)), label)
    out = every.join(home, "doc_id", "left").select(
        F.when(~F.col("nil"), F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        F.when(~F.col("nil"), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    return out, links


def _members(met: DataFrame, label: DataFrame, dense: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Members of the runs that span several components, in groups of bounded size; of hot runs,
    those whose surplus of parts does not make up for the hot ones.  And the tables behind them."""
    runs = met.where(F.col("kind") == RUN).select(F.col("x").alias("run"), F.col("y").alias("doc_id"), F.col("even").alias("hot"), "odd")
    bare = met.where(F.col("kind") == HOT_PART).groupBy(F.col("x").alias("doc_id"), F.col("y").alias("odd")).agg(F.count("*").alias("parts"))
    about = met.where((F.col("kind") == DOC) & ~F.col("nil")).select(F.col("x").alias("doc_id"), "even", F.col("odd").alias("uneven"))
    safe = bare.join(about, "doc_id").where(F.col("parts") <= F.when(F.col("odd") == 1, F.col("uneven")).otherwise(F.col("even")))
    safe = safe.select("doc_id", "odd", F.lit(1).cast("long").alias("hot")).distinct()
    member = runs.join(safe, ["doc_id", "odd", "hot"], "left_anti").select("run", "doc_id").distinct()
    member = member.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    every = member = _cuts.written(member)
    mixed = member.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("run", "size")
    member = _chunked(member.join(mixed, "run")).join(dense.withColumnRenamed("id", "doc_id"), "doc_id")
    member = _cuts.written(member.select("run", "i", "j", "part", "doc_id", "component", "n", "sketch"))
    size = member.agg(F.sum(F.octet_length("sketch") + 64)).first()[0] or 0
    groups = max(4 * _cuts.partitions(met.sparkSession), size >> 25)
    return member.withColumn("_g", F.pmod(F.xxhash64("run", "i", "j"), F.lit(groups))), [every, member]


def _homes(known: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, component_id): the least ``doc_id`` of equal sets stands for all of them."""
    same = ["sig", "check", "n_shingles"]
    least = known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"))
    least = least.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(*same, "docs", F.coalesce("component", "rep").alias("component_id"))
    least = _cuts.written(least)
    bar = max(HOT, math.ceil(HOT_SHARE * (least.agg(F.sum("docs")).first()[0] or 0)))
    hot = least.where(F.col("docs") >= bar).select(*same, F.col("component_id").alias("hot_id"))  # at most 1 / HOT_SHARE rows
    rows = known.select("doc_id", *same).join(F.broadcast(hot), same, "left")
    rest = rows.where("hot_id is null").drop("hot_id").join(least.where(F.col("docs") < bar).drop("docs"), same)
    home = rows.where("hot_id is not null").select("doc_id", F.col("hot_id").alias("component_id")).union(rest.select("doc_id", "component_id"))
    return home.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of similar ones: that with the least ``doc_id``.

    Rows without ``doc_id`` stay.  Of rows that repeat the ``doc_id`` kept, one stays for
    each different text (by the hash of all its columns).
    """
    names = docs.columns
    found, links = link(docs, k, num, den)
    # ids alone, written: the planner sees how few repeat, and texts move once
    gone = _cuts.written(found.where("component_id != doc_id").select("doc_id").distinct())
    _cuts.drop(found, links)
    ids = docs.where("doc_id is not null")
    twice = _cuts.written(ids.groupBy("doc_id").count().where("count > 1").select("doc_id").join(gone, "doc_id", "left_anti"))
    known = ids.select(*(F.col(f"`{c}`") for c in names))
    once = known.join(gone.union(twice), "doc_id", "left_anti").select(*names)
    again = known.join(twice, "doc_id", "left_semi").select(F.struct(*names).alias("row")).dropDuplicates()
    place = F.row_number().over(Window.partitionBy("row.doc_id", "row.text").orderBy(F.xxhash64("row")))
    again = again.select("row", place.alias("place")).where("place = 1").select("row.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))
