"""Language of words and of whole texts by a linear-chain conditional random field.

Words are maximal runs of letters, lower-cased; each line is a chain.  A word's features
are its affixes and inner n-grams (2 to 4 characters with the word's ends marked, and 5 at an
end), hashed, and the languages in whose lexicon it is.  Transitions between
the languages of neighbouring words are learnt with the feature weights, and
forward-backward gives every word's probabilities, so that text which switches languages
is labelled word by word.  A text's language is the one with the largest mean probability over its words.

Training reads at most ``max_train`` documents with a language outside the held-out ones, the
first by a hash of their ids; texts of more than ``max_bytes`` are not learnt from.  Their words
take the document's language.  The lexicon holds, for each language, the ``lexicon`` words in most training
documents among those with at least ``share`` of their documents in that language.  The
sample is dealt into ``shards`` or more, of about ``shard_bytes``, each fits a model by gradient ascent in its own task, and
the models' weights are averaged.  Prediction is one pass over every whole text, without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so are all
texts if nothing could be learnt; a line of more than ``CHAIN`` words is cut into chains of so
many; rows that repeat an id are predicted each; a null ``doc_id`` is not learnt from; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cuts
from . import _words as W

WORD = re.compile(r"[^\W\d_]+")
BITS = 16
CHAIN = 1 << 16
HELD = 400_000
START, END = 1, 2
NONE = "und"


class Model(NamedTuple):
    """Weights of hashed features, of lexicon membership, of transitions and of first words, by language."""

    langs: list[str]
    lexicon: dict[str, int]
    features: np.ndarray
    member: np.ndarray
    moves: np.ndarray
    first: np.ndarray


def chains(text: str) -> Iterator[list[str]]:
    """The words of every line, in order."""
    for line in text.lower().split("\n"):
        if len(line) <= CHAIN:
            if words := WORD.findall(line):
                yield words
        else:
            found = (m.group() for m in WORD.finditer(line))
            while words := list(islice(found, CHAIN)):
                yield words


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of all distinct words' affixes and n-grams."""
    points = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), "<u4")
    start = np.flatnonzero(points == START)
    stop = np.append(start[1:], len(points))
    of = np.repeat(np.arange(len(words)), stop - start)
    place = np.arange(len(points))
    h, found = np.zeros(len(points), np.uint64), []
    for k in range(1, min(6, len(points) + 1)):
        x = np.zeros(len(points), np.uint64)
        x[: len(points) - k + 1] = points[k - 1 :]
        h = W.mix(h * np.uint64(W.BASE) + x + np.uint64(k))
        if k == 1:
            continue
        on = place + k <= stop[of]
        if k == 5:
            on &= (place == start[of]) | (place + k == stop[of])
        found.append((of[on], (h[on] >> np.uint64(64 - BITS)).astype(np.int64)))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Batch:
    """Chains, longest first, as one array of word numbers ordered by place in the chain."""

    def __init__(self, rows: list[list[str]], lexicon: dict[str, int]):
        known = Numbers()
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(rows)), np.int64)
        self.words = list(known)
        self.listed = np.fromiter((lexicon.get(w, -1) for w in self.words), np.int64)
        size = np.fromiter(map(len, rows), np.int64)
        self.order = np.argsort(-size, kind="stable")
        begin = np.cumsum(size) - size
        size = size[self.order]
        #: chains that are still on at each place
        self.on = np.searchsorted(-size, -np.arange(size[0]), "left")
        place = np.repeat(np.arange(size[0]), self.on)
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(self.on) - self.on, self.on)
        self.at = begin[self.order][rank] + place  # where each token stands in the rows joined
        self.chain, self.token = self.order[rank], flat[self.at]
        self.word, self.feature = features(self.words)
        self.count = np.bincount(self.word, minlength=len(self.words))

    def emissions(self, model: Model) -> np.ndarray:
        """Scores of every distinct word for every language; its n-grams share their weight."""
        e = np.stack([np.bincount(self.word, model.features[self.feature, k], minlength=len(self.words)) for k in range(len(model.langs))], 1)
        e /= np.sqrt(self.count)[:, None]
        on = self.listed >= 0
        e[on] += model.member[self.listed[on]]
        return e

    def marginals(self, e: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Each token's probabilities, expected transitions, expected first labels, and log partition."""
        top = e.max(1)
        emit = np.exp(e - top[:, None])[self.token]
        lift = moves.max()
        a, ends = np.exp(moves - lift), np.cumsum(self.on)
        alpha, scale = np.empty_like(emit), np.empty(len(emit))
        lo = 0
        for t, hi in enumerate(ends.tolist()):
            x = emit[lo:hi] * (np.exp(first) if t == 0 else alpha[before : before + hi - lo] @ a)
            scale[lo:hi] = x.sum(1)
            alpha[lo:hi] = x / scale[lo:hi, None]
            before, lo = lo, hi
        beta, expected = np.ones_like(emit), np.zeros_like(a)
        for t in range(len(ends) - 1, 0, -1):
            lo, hi = int(ends[t - 1]), int(ends[t])
            back = int(ends[t - 2]) if t > 1 else 0
            x = emit[lo:hi] * beta[lo:hi] / scale[lo:hi, None]
            expected += (alpha[back : back + hi - lo].T @ x) * a
            beta[back : back + hi - lo] = x @ a.T
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        log_z = float(np.log(scale).sum() + top[self.token].sum() + lift * (len(emit) - self.on[0]))
        return gamma, expected, gamma[: self.on[0]].sum(0), log_z


def gradient(batch: Batch, label: np.ndarray, model: Model) -> tuple[float, list[np.ndarray]]:
    """Log likelihood of one label for each chain, and its gradient by the four kinds of weights."""
    k = len(model.langs)
    e = batch.emissions(model)
    gamma, expected, begun, log_z = batch.marginals(e, model.moves, model.first)
    y, chain_y = label[batch.chain], label[batch.order]
    seen = np.bincount(y[batch.on[0] :], minlength=k)  # every token but a chain's first follows its own label
    value = float(e[batch.token, y].sum() + model.first[chain_y].sum() + (np.diag(model.moves) * seen).sum()) - log_z
    rest = -gamma
    rest[np.arange(len(y)), y] += 1
    by_word = np.stack([np.bincount(batch.token, rest[:, j], minlength=len(batch.words)) for j in range(k)], 1)
    member = np.zeros_like(model.member)
    on = batch.listed >= 0
    np.add.at(member, batch.listed[on], by_word[on])
    shared = by_word / np.sqrt(batch.count)[:, None]
    f = np.stack([np.bincount(batch.feature, shared[batch.word, j], minlength=1 << BITS) for j in range(k)], 1)
    return value, [f, member, np.diag(seen) - expected, np.bincount(chain_y, minlength=k) - begun]


def train(rows: list[tuple[str, int]], langs: list[str], lexicon: dict[str, int], steps: int = 40, rate: float = 0.3, penalty: float = 1.0) -> Model:
    """Adam on the penalised log likelihood of (text, language number) rows."""
    k = len(langs)
    model = Model(langs, lexicon, np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    found = [(c, y) for text, y in rows for c in chains(text)]
    if not found:
        return model
    batch, label = Batch([c for c, _ in found], lexicon), np.array([y for _, y in found])
    weights = [np.array(w) for w in model[2:]]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        _, slopes = gradient(batch, label, Model(langs, lexicon, *weights))
        for w, g, m, v in zip(weights, slopes, mean, square, strict=True):
            g = (g - penalty * w) / len(batch.token)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(langs, lexicon, *weights)


def held_out(doc_id):
    """The quarter of the ids from which nothing is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, max_train: int = 4_000, max_bytes: int = 1 << 16) -> DataFrame:
    """Written (text, lang) of at most ``max_train`` rows outside the held-out quarter; rows equal in id and text count once."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= max_bytes))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = rows.groupBy("doc_id", "h").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_train)
    keys = F.broadcast(_cuts.written(keys))  # at most max_train rows
    return _cuts.written(rows.select("doc_id", "h", "text").join(keys, ["doc_id", "h"]).groupBy("doc_id", "h", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang"))


def _of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            words = {w for c in chains(text) for w in c}
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([lang] * len(words), pa.string())], ["word", "lang"])


def lexicon(labelled: DataFrame, size: int = 5_000, share: float = 0.8, least: int = 3) -> dict[str, str]:
    """For each language at most ``size`` words, with their language."""
    seen = labelled.select("text", "lang").mapInArrow(_of_words, "word string, lang string").groupBy("word", "lang").count()
    best = seen.groupBy("word").agg(F.sum("count").alias("n"), F.max(F.struct("count", "lang")).alias("top"))
    best = best.where((F.col("n") >= least) & (F.col("top.count") >= share * F.col("n"))).select("word", "n", F.col("top.lang").alias("lang"))
    place = F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)")
    return {r.word: r.lang for r in best.withColumn("place", place).where(F.col("place") <= size).collect()}


def _shard(langs: list[str], words: dict[str, int], steps: int):
    number = {x: i for i, x in enumerate(langs)}

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        pairs = [(t, number[x]) for t, x in zip(rows["text"].to_pylist(), rows["lang"].to_pylist(), strict=True)]
        model = train(pairs, langs, words, steps)
        return pa.table({"n": pa.array([len(pairs)], pa.int64()), "weights": pa.array([b"".join(w.astype("<f4").tobytes() for w in model[2:])], pa.binary())})

    return run


def fit(labelled: DataFrame, shards: int = 8, shard_bytes: int = 8 << 20, steps: int = 40, max_langs: int = 64, **lexicon_args) -> Model:
    """A model from written rows of doc_id, text and lang; at most the ``max_langs`` commonest languages."""
    shards = max(shards, -(-(labelled.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    langs = sorted(r.lang for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect())
    k, words = len(langs), {}
    if k:
        labelled = labelled.where(F.col("lang").isin(langs))
        words = {w: langs.index(x) for w, x in lexicon(labelled, **lexicon_args).items()}
    dealt = labelled.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(shards, "shard")
    rows = dealt.groupBy("shard").applyInArrow(_shard(langs, words, steps), "n long, weights binary").collect() if k else []
    total = sum(r.n for r in rows) or 1
    flat = sum((np.frombuffer(r.weights, "<f4").astype(float) * (r.n / total) for r in rows), np.zeros((1 << BITS) * k + 2 * k * k + k))
    a, b, c = (1 << BITS) * k, (1 << BITS) * k + k * k, (1 << BITS) * k + 2 * k * k
    return Model(langs, words, flat[:a].reshape(1 << BITS, k), flat[a:b].reshape(k, k), flat[b:c].reshape(k, k), flat[c:])


def _labelled(texts: Iterator[tuple[int, str | None]], model: Model) -> Iterator[tuple[Batch, np.ndarray, np.ndarray]]:
    """Chains of whole texts by bounded runs: the batch, each chain's text number, each token's probabilities."""
    rows: list[list[str]] = []
    of: list[int] = []
    n = 0

    def made() -> tuple[Batch, np.ndarray, np.ndarray]:
        batch = Batch(rows, model.lexicon)
        return batch, np.array(of), batch.marginals(batch.emissions(model), model.moves, model.first)[0]

    for i, text in texts:
        for words in chains(text or ""):
            rows.append(words)
            of.append(i)
            n += len(words)
            if n * max(4, len(model.langs)) >= 4 * HELD:
                yield made()
                rows, of, n = [], [], 0
    if rows:
        yield made()


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.langs)
        for batch in batches:
            total = np.zeros((batch.num_rows, max(k, 1)))
            if k:
                texts = ((i, t.as_py()) for i, t in enumerate(batch.column("text")))
                for b, of, gamma in _labelled(texts, model):
                    at = of[b.chain]
                    for j in range(k):
                        total[:, j] += np.bincount(at, gamma[:, j], minlength=batch.num_rows)
            n = total.sum(1)
            best = total.argmax(1)
            share = total[np.arange(len(n)), best] / np.where(n > 0, n, 1)
            named = [model.langs[j] if s else NONE for j, s in zip(best.tolist(), (n > 0).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(np.clip(share, 0, 1))], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (mean probability of that language over the words) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def _spell(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if model.langs else ():
            at, ids = np.zeros(batch.num_rows, np.int64), batch.column("doc_id")
            texts = ((i, t.as_py()) for i, t in enumerate(batch.column("text")))
            for b, of, gamma in _labelled(texts, model):
                back = np.argsort(b.at)  # as the words stand in the texts
                text, best = of[b.chain[back]], gamma[back].argmax(1)
                heads = W.heads(text)
                size = np.diff(np.append(heads, len(text)))
                place = np.arange(len(text)) - np.repeat(heads, size) + at[text]
                at[text[heads]] += size
                words, langs = np.array(b.words, object)[b.token[back]], np.array(model.langs, object)[best]
                columns = [ids.take(pa.array(text)), pa.array(place), pa.array(words, pa.string()), pa.array(langs, pa.string()), pa.array(gamma[back].max(1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "word", "lang", "score"])

    return run


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, place (from 0), word, its language and that language's probability, for every word of every row; no rows if nothing could be learnt."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_spell(model), "doc_id long, place long, word string, lang string, score double")
