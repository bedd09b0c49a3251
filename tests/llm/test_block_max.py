import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from galleon.llm import _words as W
from galleon.llm import block_max as op

from .samples import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in found:
            m = 75 + (25 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, segment int")
    return d, spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, query int")


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("size", [1 << 9, 1 << 12, op.SEGMENT])
def test_against_brute_force(spark, size):
    docs = documents(n=150)
    docs += docs[3:6]  # rows that repeat
    r = random.Random(1)
    words = [w for _, t in docs if t for w in t.split()]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(25)]
    items += [(99, None), (98, ""), (97, "nowhere"), (96, "!!"), (3, "ab " * 9), (3, items[3][1]), (items[0])]
    d, q = frames(spark, docs, items)
    want = brute(docs, [x for x in items if x[1]], 5)
    assert found(op.rank(d, q, k=5, size=size)) == want
    assert found(op.rank(d, q, k=5, size=size, items_bytes=100)) == want


def test_edges(spark):
    d, q = frames(spark, [(1, None), (2, "..."), (None, "x"), (3, "x " * 50_000), (4, "X,x\nÉ")], [(1, "x é É")])
    assert found(op.rank(d, q)) == brute([(1, None), (2, "..."), (None, "x"), (3, "x " * 50_000), (4, "X,x\nÉ")], [(1, "x é É")], 20)
    assert op.rank(d.limit(0), q).count() == 0 and op.rank(d, q.limit(0)).count() == 0
    d, q = frames(spark, [(5, "same"), (None, "same"), (2, "same"), (9, "other thing"), (8, "more"), (7, "words")], [(1, "same")])
    assert [r[2] for r in sorted(found(op.rank(d, q)), key=lambda r: r[1])] == [2, 5, None]


def test_packed_blocks_come_back():
    r = np.random.default_rng(0)
    for top in (1, 200, 70_000, 1 << 30):
        gaps, impacts = r.integers(0, top, 700), r.integers(0, 1_000_000, 700)
        heads = np.array([0, 128, 129, 400])
        gaps[heads] = 0
        for data, a, b in zip(op.pack(gaps, impacts, heads), heads, [*heads[1:], 700], strict=True):
            d, x = op.unpack(data, 5)
            assert (d == 5 + np.cumsum(gaps[a:b])).all() and (x == impacts[a:b]).all()


def test_blocks_below_the_threshold_stay_packed():
    r = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(common, k=30)) + (" rare" * 40 if 4000 <= i < 4030 else "") for i in range(8000)]
    t = W.texts(pa.array(texts))
    rows = pa.Table.from_batches([op.segment(0, list(range(8000)), t, 8000, 8000 * 30)])
    lists = op.Lists(rows.filter(pa.compute.is_valid(rows["term"])))
    n, want = len(lists.data), Counter()
    query = [("rare", 5000), ("w1", 90), ("w2", 80)]
    for name, w in query:
        s = lists.of[name.encode()]
        for d, x in zip(*lists.postings(np.arange(s.start, s.stop)), strict=True):
            want[int(d)] += w * int(x)
    lists.kept.clear()
    lists.unpacked = 0
    d, score = op.best(lists, [(name.encode(), w) for name, w in query], 8000, 20)
    assert list(zip(d.tolist(), score.tolist(), strict=True)) == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:20]
    blocks = sum(lists.of[name.encode()].stop - lists.of[name.encode()].start for name, _ in query)
    assert lists.unpacked <= blocks / 8 and blocks < n
