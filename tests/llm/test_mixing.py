import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from galleon.llm import mixing as op

from .samples import WORD


def sample(spark, seed=0, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice(["hot"] * 6 + ["a", "b", "c", None])
        rows.append((None if i % 97 == 5 else i, None if i % 50 == 3 else "w " * r.randint(0, 30), s, i))
    rows += rows[:3]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")


def weights(share, alpha):
    w = {s: t**alpha for s, t in share.items() if t}
    z = sum(w.values())
    return {s: x / z for s, x in w.items()}


@pytest.mark.parametrize("budget", ["tokens", "cover", 9000])
def test_against_brute_force(spark, budget):
    rows, df = sample(spark)
    out = op.mix(df, entropy=0.97, repeats=3.0, budget=budget).collect()
    share, docs = Counter(), defaultdict(list)
    for i, t, s, _ in rows:
        share[s] += len(WORD.findall(t or ""))
        docs[s].append((i, len(WORD.findall(t or ""))))
    total = sum(share.values())
    amount = total if budget == "tokens" else budget
    size = {"tokens": 1.0, "cover": None}.get(budget, 9000 / total)
    # the exponent, by plain bisection
    target = 0.97 * math.log(len([s for s in share if share[s]]))
    entropy = lambda a: -sum(w * math.log(w) for w in weights(share, a).values())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= target else (lo, mid)
    alpha = lo if entropy(1.0) < target else 1.0
    ratio = lambda a: max(weights(share, a)[s] / share[s] for s in share)
    if budget == "cover":
        least = lambda a: min(weights(share, a)[s] / share[s] for s in share)
        over = lambda a: ratio(a) / least(a) > 3.0
    else:
        over = lambda a: ratio(a) * total * size > 3.0
    if over(alpha):
        lo, hi = alpha, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if over(mid) else (lo, mid)
        alpha = hi
    w = weights(share, alpha)
    if budget == "cover":
        amount = max(share[s] / w[s] for s in w)
    got = Counter()
    copies = defaultdict(set)
    for r in out:
        got[r.source] += r.mix_tokens
        copies[(r.doc_id, r.text, r.source, r.tokens)].add(r.mix_copy)
    for s in share:
        quota = w[s] * amount
        longest = max(n for _, n in docs[s])
        assert quota - 2 * longest - 0.01 * quota <= got[s] <= quota * 1.001 + 1, s
        epochs = int((quota + 1e-3 * 0) // share[s])
        for i, t, x, y in rows:
            if x == s:
                assert copies[(i, t, x, y)] in ({*range(1, epochs + 1)}, {*range(1, epochs + 2)}, {*range(1, epochs)}) or abs(quota / share[s] - round(quota / share[s])) < 1e-3
    assert {"doc_id", "text", "source", "tokens"} <= set(out[0].asDict())


def test_cover_keeps_large_sources_whole(spark):
    for seed in (2, 43):
        r = random.Random(seed)
        sizes = [r.randint(3 * 10**10, 5 * 10**10)] + [r.randint(10**9, 2 * 10**10) for _ in range(3)]
        rows = [(10 * i + j, f"s{i}", n // 2 + j * (n % 2)) for i, n in enumerate(sizes) for j in range(2)]
        df = spark.createDataFrame(rows, "doc_id long, source string, n long")
        out = op.mix(df, tokens=F.col("row.n"), entropy=None, repeats=None, budget="cover").collect()
        assert {x.doc_id for x in out} == {i for i, _, _ in rows}


def test_one_source_and_empty(spark):
    _, df = sample(spark)
    one = df.withColumn("source", F.lit("x"))
    assert op.mix(one).count() == one.count()
    assert op.mix(df.limit(0)).collect() == []
    assert op.mix(df.withColumn("text", F.lit(None).cast("string"))).count() == df.count()


def test_blocks_hold_their_budget_and_mixture(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(1, 20), r.choice(["hot"] * 6 + ["a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op.mix(df, entropy=0.97, block_tokens=2000).collect()
    total = sum(x.mix_tokens for x in out)
    of = Counter()
    for x in out:
        of[x.source] += x.mix_tokens
    blocks = max(x.mix_block for x in out) + 1
    assert blocks == math.ceil(sum(len(t.split()) for _, t, _ in rows) / 2000)
    held = defaultdict(Counter)
    for x in out:
        held[x.mix_block][x.source] += x.mix_tokens
    for b in range(blocks):
        assert all(abs(held[b][s] - of[s] / blocks) <= 20 for s in of)
        assert abs(sum(held[b].values()) - total / blocks) <= 40
    # epochs come one after the other, and slots mix the sources evenly
    one = sorted((x.mix_block, x.mix_slot, x.mix_copy) for x in out if x.source == "a")
    assert [c for _, _, c in one] == sorted(c for _, _, c in one)
    half = Counter()
    for x in out:
        half[x.source] += x.mix_tokens * (x.mix_slot < op.SLOTS // 2)
    assert all(abs(half[s] - of[s] / 2) <= 20 * blocks for s in of)


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c", "s"), (1, "a b c d", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op.mix(df, budget=5).collect()
    assert len(out) == 1 and out[0].mix_tokens in (3, 4)
    same = spark.createDataFrame([(1, "a b", "s")] * 10 + [(None, "c d", "s")] * 10, df.schema)
    assert sum(x.mix_tokens for x in op.mix(same, budget=30).collect()) == 30


def test_names_that_clash_come_back(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7, 8, 9, {"x": 1})], "doc_id long, text string, source string, mix_copy int, input_mix_copy int, tokens int, h map<string,int>")
    (row,) = op.mix(df).collect()
    assert (row.input_input_mix_copy, row.input_mix_copy, row.mix_copy, row.tokens, row.h) == (7, 8, 1, 9, {"x": 1})


def test_very_long_and_empty_texts(spark):
    rows = [(0, "w " * 200_000, "s"), *((i, "w " * (i % 3), "s") for i in range(1, 100)), (200, None, "t"), (201, "", "t")]
    out = op.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=1000).collect()
    assert Counter(x.doc_id for x in out) == Counter(i for i, _, _ in rows)
    assert sum(x.mix_tokens for x in out) == sum(len((t or "").split()) for _, t, _ in rows)


@pytest.mark.parametrize("budget", ["tokens", "cover", 100])
def test_nothing_to_mix(spark, budget):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "t")], "doc_id long, text string, source string")
    assert {x.doc_id for x in op.mix(df, budget=budget).collect()} == {1, 2}
    assert op.mix(df.limit(0), budget=budget).collect() == []


def test_copies_are_the_same_when_not_laid(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 5 if i % 3 else 0}", i % 2) for i in range(400)] + [(7, None, None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy int")
    for args in ({"entropy": 0.99, "repeats": 3.0}, {"budget": "cover"}):
        both = [op.mix(df, laid=laid, **args).select("doc_id", "source", "input_mix_copy", "mix_copy", "mix_tokens") for laid in (True, False)]
        assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
