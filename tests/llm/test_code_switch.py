import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleon.llm import code_switch as op

SYLLABLES = {"aa": ["ko", "ra", "mi", "tu", "so"], "bb": ["schl", "ung", "eit", "pfe", "bar"], "cc": ["eau", "oui", "lle", "que", "ché"]}


def word(r, lang):
    return "".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4)))


def corpus(seed=0, n=240):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, "\n".join(" ".join(word(r, lang) for _ in range(r.randint(1, 15))) + "." for _ in range(r.randint(1, 5))), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "src", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")


def random_model(k=3, seed=0):
    r = np.random.default_rng(seed)
    return op.Model([str(i) for i in range(k)], {"ab": 1, "b": 0}, r.normal(size=(1 << op.BITS, k)), r.normal(size=(k, k)), r.normal(size=(k, k)), r.normal(size=k))


def test_forward_backward_is_the_sum_over_all_labellings():
    model, rows = random_model(), [["ab", "c"], ["b"], ["a", "b", "c", "ab"]]
    batch = op.Batch(rows, model.lexicon)
    e = batch.emissions(model)
    gamma, expected, begun, log_z = batch.marginals(e, model.moves, model.first)
    number = {w: i for i, w in enumerate(batch.words)}
    want, moves, first, total = [], np.zeros((3, 3)), np.zeros(3), 0.0
    for row in rows:
        each, z = np.zeros((len(row), 3)), 0.0
        m, f = np.zeros((3, 3)), np.zeros(3)
        for y in itertools.product(range(3), repeat=len(row)):
            p = np.exp(model.first[y[0]] + sum(e[number[w], k] for w, k in zip(row, y, strict=True)) + sum(model.moves[a, b] for a, b in itertools.pairwise(y)))
            z += p
            f[y[0]] += p
            for t, k in enumerate(y):
                each[t, k] += p
            for a, b in itertools.pairwise(y):
                m[a, b] += p
        want.append(each / z)
        moves, first, total = moves + m / z, first + f / z, total + np.log(z)
    back = np.argsort(batch.at)
    assert np.allclose(gamma[back], np.concatenate(want)) and np.allclose(expected, moves) and np.allclose(begun, first) and np.isclose(log_z, total)


def test_gradient_is_that_of_the_likelihood():
    model, rows, label = random_model(), [["ab", "c"], ["b"], ["a", "b", "c", "ab"]], np.array([0, 2, 1])
    batch = op.Batch(rows, model.lexicon)
    _, slopes = op.gradient(batch, label, model)
    for which, places in ((2, [(1, 0), (0, 2)]), (3, [(0, 0), (2, 1)]), (4, [(1,), (2,)]), (1, [(int(batch.feature[0]), 1), (int(batch.feature[-1]), 0)])):
        kind = {1: 0, 2: 1, 3: 2, 4: 3}[which]
        for at in places:
            values = []
            for step in (1e-5, -1e-5):
                w = [np.array(x) for x in model[2:]]
                w[kind][at] += step
                values.append(op.gradient(batch, label, op.Model(model.langs, model.lexicon, *w))[0])
            assert np.isclose((values[0] - values[1]) / 2e-5, slopes[kind][at], rtol=1e-4, atol=1e-6)


def test_features_are_affixes_and_inner_runs():
    def grams(w):
        x = f"\x01{w}\x02"
        return sum(max(0, len(x) - k + 1) for k in (2, 3, 4)) + len({i for i in (0, len(x) - 5) if len(x) >= 5})

    words = ["a", "ab", "abc", "abcdef", "été", "\U00010400\U00010401"]
    of, f = op.features(words)
    assert np.bincount(of, minlength=len(words)).tolist() == [grams(w) for w in words]
    one = [set(op.features([w])[1].tolist()) for w in words]
    assert [set(f[of == i].tolist()) for i in range(len(words))] == one


@pytest.fixture(scope="module")
def fitted(spark):
    docs = frame(spark, corpus())
    return docs, op.fit(op.sample(docs), shards=3)


def test_held_out_accuracy(spark, fitted):
    docs, model = fitted
    rows = op.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(op.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 30 and all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in rows)


def test_words_of_mixed_text(spark, fitted):
    r = random.Random(5)
    langs = [x for _ in range(12) for x in [r.choice(list(SYLLABLES))] * r.randint(4, 9)]
    text = " ".join(word(r, x) for x in langs)
    rows = op.label_words(frame(spark, [(1, text, None), (2, "\n\n" + text + "\n" + text, None), (3, None, None)]), fitted[1]).orderBy("doc_id", "place").collect()
    assert [x.word for x in rows] == text.split() * 3 and [x.place for x in rows] == [*range(len(langs)), *range(2 * len(langs))]
    assert sum(x.lang == y for x, y in zip(rows, langs * 3, strict=True)) / len(rows) > 0.95


def test_nothing_else_is_an_input(spark, fitted):
    docs, model = fitted
    other = docs.withColumns({"lang": F.when(op.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")), "source": F.lit("q")})
    again = op.fit(op.sample(other), shards=3)
    assert again.langs == model.langs and all(np.array_equal(a, b) for a, b in zip(again[2:], model[2:], strict=True))


def test_edges(spark, fitted):
    _, model = fitted
    odd = frame(spark, [(1, None, "aa"), (2, "", None), (3, "12 _ 3", None), (3, "kora", None), (None, "schlung", "bb"), (5, "kora mitu " * 40_000, None), (6, "日本", None)])
    out = {(r.doc_id, r.lang_pred) for r in op.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (3, "aa"), (None, "bb"), (5, "aa")} <= out
    assert all(r.score == 0 for r in op.predict(odd, model).where("lang_pred = 'und'").collect())
    none = op.fit(op.sample(odd.limit(0)))
    assert {(r.lang_pred, r.score) for r in op.predict(odd, none).collect()} == {("und", 0.0)}
    assert op.predict(odd.limit(0), model).count() == 0 and op.label_words(odd, none).count() == 0
    one = op.fit(op.sample(frame(spark, [(i, "kora", "aa") for i in range(20)])))
    assert {r.lang_pred for r in op.predict(odd, one).collect()} == {"aa", "und"}
    assert op.sample(frame(spark, corpus()), max_train=7).count() == 7
