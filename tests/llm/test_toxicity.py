import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from galleon.llm import _words as W
from galleon.llm import toxicity as op


def labelled(spark, n=900, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.15)
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), "zork" + r.choice(["", "ing", "ED", "ly"]))
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 0, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = op.fit(op.sample(docs, labels))
    out = op.score(docs, model).join(labels, "doc_id").where(op.held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()
    assert len(out) > 200 and all(0 <= r.score <= 1 for r in out)
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in out)
    assert right / len(out) > 0.97
    assert sum(r.score >= 0.7 for r in out if r.toxic) / sum(r.toxic for r in out) > 0.9


def test_held_out_rows_teach_nothing(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(op.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (op.fit(op.sample(docs, x)) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_edges(spark):
    docs, labels = labelled(spark, 120)
    none = op.fit(op.sample(docs, labels.limit(0)))
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "zork " * 30_000), (4, "é" * 10)], "doc_id long, text string")
    assert {r.score for r in op.score(odd, none).collect()} == {op.score(odd, none).first().score}
    one = op.fit(op.sample(docs, labels.withColumn("toxic", F.lit(1))))
    assert all(r.score > 0.9 for r in op.score(odd, one).collect())
    assert op.score(odd.limit(0), one).collect() == []
    assert op.score(odd, op.fit(op.sample(docs, labels))).count() == 5


def features(text):
    """Features of a text by plain Python: every distinct run of 4 to 7 characters."""
    x = " " + "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub("[\x20\x09-\x0d]", " ", text)) + " "
    return {op.feature_of(x[i : i + k]) for k in op.SIZES for i in range(len(x) - k + 1)}


ODD = ["", "a", "ab", "caf\u00e9 \u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8", "\U0001f600\U0001f601\U0001f602\U0001f603", "A\tB\nC d\u00c9", "\u00e9" * 9, "x" * 40]


def test_features_are_those_of_characters():
    texts = [*ODD, *ODD[::-1]]
    found = [set() for _ in texts]
    for _, _, of, f in op.grams(W.texts(pa.array(texts))):
        for i, x in zip(of.tolist(), f.tolist(), strict=True):
            found[i].add(x)
    assert found == [features(t) for t in texts]


def test_ratios_against_brute_force(spark):
    docs, labels = labelled(spark, 200)
    rows = [(r.text + " \u00e9t\u00e9", r.toxic) for r in docs.join(labels, "doc_id").where("toxic is not null").collect()]
    counts, n = {0: Counter(), 1: Counter()}, Counter(y for _, y in rows)
    for t, y in rows:
        counts[y].update(features(t))
    want = {}
    for f in counts[0] | counts[1]:
        r = math.log((counts[1][f] + 1) / (n[1] + 2)) - math.log((counts[0][f] + 1) / (n[0] + 2))
        if counts[0][f] + counts[1][f] >= 4 and abs(r) >= 0.7:
            want[f] = r
    found = op.ratios(spark.createDataFrame(rows, "text string, toxic int"), max_features=10**6)
    assert found[0].tolist() == sorted(want) and np.allclose(found[1], [want[f] for f in sorted(want)])


def test_sample_bounds_rows(spark):
    docs, labels = labelled(spark, 60)
    i = next(r.doc_id for r in docs.where(~op.held_out(F.col("doc_id"))).orderBy("doc_id").collect() if r.doc_id != 3)
    more = docs.union(spark.createDataFrame([(i, f"text {j % 50}", "x") for j in range(500)], docs.schema))
    assert op.sample(more, labels, max_train=20).count() == 20
    assert op.sample(more, labels).count() == op.sample(docs, labels).count() + 50
