"""Toxicity by a linear classifier over character n-grams with naive Bayes features.

Texts are lower-cased (A-Z), their white space made blanks, and a blank put before and
after; every n-gram of 4 to 7 characters (code points) is hashed to one of 2**20
features, present or absent.  Each feature is scaled by
its naive Bayes log-count ratio between the classes, and logistic regression with an L2
penalty is fitted on the scaled features.

Fitting reads a bounded sample of labelled rows (``max_train``, by hash of id and text; rows
equal in both count once): the
features' document counts are summed per task and merged by ranges of features.  Features in
fewer than ``least`` (4) rows or with a ratio below 0.7 in size (odds under two to one) are
left out as noise, the ``max_features`` (8,192) with the strongest ratios of the others are kept, and only
their presence in the sample comes to the driver.  These cuts choose features; no row or text is cut.  Scoring is one pass over every whole text.

Defined cases: null and empty texts get the score of a text without features; labels
without text or without a label are not learnt from; rows that repeat an id are scored
each; with one class only, every score is that class's share; an empty table gives an
empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cuts
from . import _words as W

SIZES = (4, 5, 6, 7)
BITS = 20
RANGES = 64
CLEAN = W.LOWER.copy()
CLEAN[~W.INWORD] = 0x20


class Model(NamedTuple):
    """Kept features in order, their weights (ratio included) and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def grams(t: W.Texts, keep: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts [a, b): distinct (text, feature) pairs, of the masked features only."""
    for a, b in t.slices(1 << 19):
        lo, hi = int(t.offsets[a]), int(t.offsets[b])
        # a blank before and after every text
        size = np.diff(t.offsets[a : b + 1]) + 2
        ends = np.cumsum(size)
        x = np.full(int(ends[-1]), 0x20, np.uint8)
        x[np.arange(hi - lo) + np.repeat(np.arange(b - a) * 2 + 1, size - 2)] = CLEAN[t.data[lo:hi]]
        start = np.append(np.flatnonzero((x & 0xC0) != 0x80), len(x))  # of every character
        sums = W.prefix(x)[start]
        inverse = W.powers(W.INVERSE, len(x))[start[:-1]]
        stop = np.searchsorted(start, ends)
        stop = np.repeat(stop, np.diff(stop, prepend=0))  # the character after a text's last
        found = []
        for k in SIZES:
            n = len(start) - k
            if n <= 0:
                continue
            h = sums[k:] - sums[:-k]
            h *= inverse[:n]
            f = (W.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
            ok = np.arange(n) + k <= stop[:n]
            if keep is not None:
                ok &= keep[f]
            at = np.flatnonzero(ok)
            found.append((np.searchsorted(ends, start[at], "right") << BITS) | f[at])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        yield a, b, (pair >> BITS) + a, pair & ((1 << BITS) - 1)


def feature_of(gram: str) -> int:
    """The feature of one n-gram, cleaned as texts are."""
    x = CLEAN[np.frombuffer(gram.encode(), np.uint8)]
    return int(W.mix(W.prefix(x)[-1:])[0] >> np.uint64(64 - BITS))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        y = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        seen += np.bincount(y, minlength=2)
        for _, _, of, f in grams(W.texts(batch.column("text"))):
            for c in (0, 1):
                counts[c] += np.bincount(f[y[of] == c], minlength=1 << BITS)
    step = (1 << BITS) // RANGES
    rows = [(r, *(counts[c, r * step : (r + 1) * step].tobytes() for c in (0, 1)), *map(int, seen)) for r in range(RANGES)]
    yield pa.RecordBatch.from_pydict({n: [x[i] for x in rows] for i, n in enumerate(("range", "clean", "toxic", "n_clean", "n_toxic"))})


def _ratios(least: int, smooth: float):
    def run(rows: pa.Table) -> pa.Table:
        clean, toxic = (sum(np.frombuffer(x.as_py(), np.int64) for x in rows[c]) for c in ("clean", "toxic"))
        n_clean, n_toxic = (sum(rows[c].to_pylist()) for c in ("n_clean", "n_toxic"))
        r = np.log((toxic + smooth) / (n_toxic + 2 * smooth)) - np.log((clean + smooth) / (n_clean + 2 * smooth))
        at = np.flatnonzero((clean + toxic >= least) & (np.abs(r) >= 0.7))
        first = rows["range"][0].as_py() * ((1 << BITS) // RANGES)
        return pa.table({"feature": at + first, "ratio": r[at], "strength": np.abs(r[at]) * np.sqrt(clean + toxic)[at]})

    return run


def _present(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[features] = True
        for batch in batches:
            t = W.texts(batch.column("text"))
            has = [np.zeros(0, np.int32)] * batch.num_rows
            for _, _, of, f in grams(t, keep):
                start = W.heads(of)
                for i, x in zip(of[start], np.split(np.searchsorted(features, f).astype(np.int32), start[1:]), strict=False):
                    has[i] = x
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "has": pa.array(has, pa.list_(pa.int32()))})

    return run


def _logistic(size: np.ndarray, col: np.ndarray, y: np.ndarray, scale: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean log loss plus the L2 penalty; both classes weigh
    the same.  Row ``i`` has ``size[i]`` features, listed in ``col``."""
    share = y.mean()
    each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    row = np.repeat(np.arange(len(size)), size)
    v = scale[col]
    rate = 4 / max(1.0, float(np.bincount(row, v * v, minlength=len(size)).max(initial=0)) + 1)
    rate = min(rate * 8, 0.5)
    w = np.zeros(len(scale) + 1)
    prev, best = w.copy(), (np.inf, w)
    for i in range(steps):
        z = w + (i / (i + 3)) * (w - prev)
        m = np.bincount(row, v * z[col], minlength=len(size)) + z[-1]
        p = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
        loss = float(each @ (np.logaddexp(0, m) - y * m) + penalty / 2 * (z[:-1] @ z[:-1]))
        if loss > best[0] + 1e-9:
            rate, prev, w = rate / 2, best[1].copy(), best[1].copy()
            best = (best[0] + 1e-6, best[1])
            continue
        best = (loss, z)
        d = (p - y) * each
        g = np.append(np.bincount(col, v * d[row], minlength=len(scale)) + penalty * z[:-1], d.sum())
        prev, w = w, z - rate * g
    return best[1][:-1] * scale, float(best[1][-1])


def ratios(labelled: DataFrame, max_features: int = 8192, least: int = 4, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The strongest features, in order, and their naive Bayes log-count ratios."""
    ranges = labelled.select("text", "toxic").mapInArrow(_counts, "range long, clean binary, toxic binary, n_clean long, n_toxic long")
    found = ranges.groupBy("range").applyInArrow(_ratios(least, smooth), "feature long, ratio double, strength double")
    kept = sorted((r.feature, r.ratio) for r in found.orderBy(F.desc("strength"), "feature").limit(max_features).collect())
    return np.array([f for f, _ in kept], np.int64), np.array([r for _, r in kept])


def fit(labelled: DataFrame, max_features: int = 8192, least: int = 4, smooth: float = 1.0, penalty: float = 1e-4) -> Model:
    """A model from rows of ``text`` and ``toxic`` (0 or 1); read twice, so give a written table."""
    features, ratio = ratios(labelled, max_features, least, smooth)
    rows = labelled.select("text", "toxic").mapInArrow(_present(features), "toxic int, has array<int>").toArrow()
    y = rows["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    size = pa.compute.list_value_length(rows["has"]).to_numpy()
    col = pa.compute.list_flatten(rows["has"]).to_numpy().astype(np.int64)
    weights, bias = _logistic(size, col, y, ratio, penalty)
    return Model(features, weights, bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[model.features] = True
        weight = np.zeros(1 << BITS)
        weight[model.features] = model.weights
        for batch in batches:
            m = np.full(batch.num_rows, model.bias)
            for a, b, of, f in grams(W.texts(batch.column("text")), keep):
                m[a:b] += np.bincount(of - a, weight[f], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(m, -700, 700))))], ["doc_id", "score"])

    return run


def sample(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """Texts and labels of at most ``max_train`` labelled rows outside the held-out third; rows
    that repeat id and text count once, and an id labelled both ways is toxic."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = _cuts.written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    rows = rows.join(F.broadcast(known), "doc_id")  # at most max_train rows
    chosen = rows.groupBy("doc_id", "h").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_train)
    chosen = _cuts.written(chosen.select("doc_id", "h"))
    rows = rows.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return _cuts.written(rows.select("text", "toxic"))


def held_out(doc_id):
    """The third of the ids from which nothing is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, score double")
