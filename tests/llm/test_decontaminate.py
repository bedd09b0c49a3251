import random

import numpy as np
import pyarrow as pa
import pytest

from galleon.llm import decontaminate as op

from .samples import WORD


def edit(a, b):
    """Least edits of ``a`` to a stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def corpus(seed, n=150, rate=1.0):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)] + ["the", "of", "and"] * 200
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(words(r.choice([1, 3, 6, 9, 15, 20, 35, 59, 90])))) for i in range(30)] + [(None, " ".join(words(30))), (77, None), (78, " \n")]
    docs = []
    for i in range(n):
        w = words(r.randint(0, 150))
        if r.random() < 0.5:
            x = WORD.findall(r.choice(items[:31])[1])
            for _ in range(r.randint(0, int(op.EDITS * len(x) * rate))):
                j = r.randrange(len(x))
                r.choice([lambda: x.pop(j), lambda: x.insert(j, r.choice(vocab)), lambda: x.__setitem__(j, r.choice(vocab))])()
            at = r.randint(0, len(w))
            w[at:at] = [y.upper() for y in x] if r.random() < 0.3 else x
        docs.append((i, r.choice([" ", "\n"]).join(w)))
    return docs + [(None, docs[1][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "the " * 3000)], items


def brute(docs, items):
    out = set()
    for n, (d, t) in enumerate(docs):
        w = WORD.findall((t or "").lower())
        for i, x in items:
            x = WORD.findall((x or "").lower())
            if x and edit(x, w) <= int(op.EDITS * len(x) + 1e-9):
                out.add((n, d, i, edit(x, w)))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(docs)], "doc_id long, text string, item_id int, distance string"),
        spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, doc_id int"),
    )


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_and_exact_distances(spark, seed):
    docs, items = corpus(seed)
    want = {(d, i, far) for _, d, i, far in brute(docs, items)}
    found = {(r.doc_id, r.item_id, r.distance) for r in op.find(*frames(spark, docs, items)).collect()}
    assert {(d, i) for d, i, _ in found} <= {(d, i) for d, i, _ in want}
    assert len(found & want) >= 0.9 * len(want)


def test_copies_and_few_edits_are_all_found(spark):
    docs, items = corpus(3, rate=0.0)
    want = {(d, i, far) for _, d, i, far in brute(docs, items) if far == 0}
    found = {(r.doc_id, r.item_id, r.distance) for r in op.find(*frames(spark, docs, items)).collect()}
    assert want <= found


def test_places(spark):
    docs, items = frames(spark, [(1, "x y a b c d e f g h i j k l z")], [(7, "a b c d e F g h i j k l")])
    r = op.find(docs, items).first()
    assert (r.distance, r.start_word, r.end_word, r.item_words) == (0, 2, 14, 12)


def test_clean_keeps_the_rest(spark):
    docs, items = corpus(4)
    df, bench = frames(spark, docs, items)
    found = {(r.doc_id, r.text) for r in op.find(df, bench).join(df.drop("item_id", "distance"), "doc_id").collect()}
    kept = op.clean(df.withColumn("_text", df.item_id), bench).drop("_text").collect()
    assert kept and set(kept[0].asDict()) == {"doc_id", "text", "item_id", "distance"}
    assert {(r.doc_id, r.text) for r in kept if r.doc_id is not None} == {x for x in docs if x[0] is not None} - found


def test_empty(spark):
    df, bench = frames(spark, *corpus(5))
    assert op.find(df.limit(0), bench).collect() == [] and op.find(df, bench.limit(0)).collect() == []
    assert op.clean(df, bench.limit(0)).count() == df.count()


@pytest.mark.parametrize("kinds", ["ids", "i", "d", "s", "every"])
@pytest.mark.parametrize("n", [7, 10, 14, 20, 30, 45, 63, 64, 90, 127, 128, 200, 256, 512, 800, 1023, 1500])
def test_recall_at_the_full_bound(n, kinds):
    """Mixed, inserted, deleted and replaced words alone, and every so-many-th word struck out."""
    r = random.Random(n)
    vocab = [f"w{i}" for i in range(3000)]
    items, docs = [r.choices(vocab, k=n) for _ in range(60 if n < 300 else 25)], []
    for x in items:
        y, k = list(x), int(op.EDITS * n)
        if kinds == "every":
            gone = set(range(3, n, -(-n // max(1, k)))[:k]) if k else set()
            y = [w for j, w in enumerate(y) if j not in gone]
        for _ in range(k if kinds != "every" else 0):
            p, kind = r.randrange(len(y)), r.choice(kinds)
            y[p : p + (kind != "i")] = [] if kind == "d" else [r.choice(vocab)]
        docs.append(" ".join(r.choices(vocab, k=20) + y + r.choices(vocab, k=20)))
    q = op.prepare([(i, " ".join(x)) for i, x in enumerate(items)])
    found = [next(op._search(q)(iter([pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]})]))) for i, t in enumerate(docs)]
    hit = sum(i in b.column("item_id").to_pylist() for i, b in enumerate(found))
    assert hit >= 0.9 * len(items)


def test_the_distance_is_the_least_around_all_candidates():
    """Stretches that overlap are searched together: a worse one before a better one does not hide it."""
    item = [f"w{i}" for i in range(40)]
    worse = [x for j, x in enumerate(item) if j % 8 != 3]
    text = " ".join([*worse[:-6], *item[:30], "zz", *item[30:]])
    q = op.prepare([(1, " ".join(item))])
    out = next(op._search(q)(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]))).to_pylist()
    assert [r["distance"] for r in out] == [1]
