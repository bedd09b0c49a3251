import random
import re
from collections import Counter

import numpy as np
import pytest

from galleon.llm import quality_rules as op

from .samples import WORD, documents, frame


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(win), set()
    for i, x in enumerate(win):
        if seen[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def junk(r):
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    clean = " ".join(word() for _ in range(r.randint(15, 80))) + "."
    kinds = [clean] * 12 + [re.sub(r"(\w) ", r"\1%%% ", clean), " | ".join(clean.split()), clean.upper(), (word() + " ") * 40, "x y"]
    return r.choice(kinds)


@pytest.mark.parametrize("seed", [0, 1])
def test_counts_against_brute_force(spark, seed):
    rows = documents(seed, n=50) + [(5000, "a\x0bb\x0cc\rd\te"), (5001, "l\nl\n l\nl\n\n\n"), (5002, "a b c d e a b c d e x a b c d e"), (5003, "é " * 9), (5004, "*" * 50)]
    rows += random.Random(seed).sample(rows, 2)
    found = sorted((tuple(r[c] for c in ("doc_id", *op.COUNTS)) for r in op.judge(frame(spark, rows)).collect()), key=str)
    assert found == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_clean_stays_and_junk_goes(spark):
    r = random.Random(3)
    rows = [(i, junk(r)) for i in range(600)]
    df = frame(spark, rows)
    out = {x.doc_id: x for x in op.judge(df).collect()}
    for i, t in rows:
        n, _, symbols, _, repeats = brute(t)
        x = out[i]
        assert x.base_failed == (n < 10 or 100 * repeats > 20 * n)
        good = not x.base_failed and 10 * symbols <= n and t != t.upper()
        assert x.kept == good, t
    kept = op.keep(df.withColumn("_q_votes", df.doc_id).withColumn("_q_w", df.text)).drop("_q_votes", "_q_w")
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, x in out.items() if x.kept}


def pattern(**votes):
    return [votes.get(n, 1) for n in op.RULES]


def brute_fit(patterns, rounds=3000):
    """The same model by whole matrices: good votes are 1, bad ones 0, abstentions missing."""
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    yes, no = (v > 0).astype(float), (v < 0).astype(float)
    first = op.start()
    share0, rate0 = np.array(first.share), np.array(first.good_votes)
    share, rate = share0, rate0
    for _ in range(rounds):
        like = share * np.exp(yes @ np.log(rate).T + no @ np.log(1 - rate).T)
        of = like / like.sum(1, keepdims=True) * n[:, None]
        share = (of.sum(0) + op.WEIGHT * share0) / (n.sum() + op.WEIGHT)
        rate = (of.T @ yes + op.WEIGHT * rate0) / (of.T @ (yes + no) + op.WEIGHT)
    like = share * np.exp(yes @ np.log(rate).T + no @ np.log(1 - rate).T)
    return share, rate, like[:, 0] / like.sum(1)


@pytest.mark.parametrize("seed", range(4))
def test_estimates_against_brute_force(seed):
    r = random.Random(seed)
    kinds = [[0.95] * len(op.RULES), *([0.2 if n in known else 0.9 for n in op.RULES] for known in op.KINDS.values())]
    seen = Counter()
    for _ in range(1500):
        k = r.choices(range(5), [0.8, 0.1, 0.05, 0.03, 0.02])[0]
        seen[tuple(0 if r.random() < 0.1 else 1 if r.random() < kinds[k][j] else -1 for j in range(len(op.RULES)))] += 1
    patterns = sorted((list(p), c) for p, c in seen.items())
    found = op.fit(patterns)
    share, rate, good = brute_fit(patterns)
    assert np.abs(np.array(found.share) - share).max() < 1e-6 and np.abs(np.array(found.good_votes) - rate).max() < 1e-6
    odds = found.odds()
    assert max(abs(op.memberships(p, odds)[0] - g) for (p, _), g in zip(patterns, good, strict=True)) < 1e-6


def test_the_data_decide_the_verdict():
    """One vote pattern, two corpora: it is junk where the rule agrees with another one, and style where it stands alone."""
    clean, alone, both = pattern(), pattern(symbols=-1), pattern(symbols=-1, plain_words=-1)
    good = lambda p, corpus: op.memberships(p, op.fit(corpus).odds())[0]
    assert op.memberships(alone, op.start().odds())[0] > 0.5
    assert good(alone, [(clean, 9000), (both, 900), (alone, 5)]) < 0.5
    assert good(alone, [(clean, 9000), (both, 900), (alone, 4000)]) > 0.5
    assert good(clean, [(clean, 9000), (both, 900)]) > 0.99 > 0.01 > good(both, [(clean, 9000), (both, 900)])
    for rule in op.RULES:  # no rule is a veto: common enough, its bad votes are style
        assert good(pattern(**{rule: -1}), [(clean, 1000), (pattern(**{rule: -1}), 1000)]) > 0.5


def test_verdicts_leave_the_start_values(spark):
    """On a table with little-known junk, estimation rejects what the start would keep."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    prose = lambda k, mark="": " ".join(word() + mark for _ in range(k)) + "."
    some = lambda k: " ".join(word() + ("%%" if i % 3 == 0 else "") for i in range(k)) + "."
    rows = [(i, prose(50)) for i in range(900)] + [(1000 + i, prose(50, "%%")) for i in range(90)] + [(2000 + i, some(50)) for i in range(9)]
    out = {x.doc_id: x for x in op.judge(frame(spark, rows)).collect()}
    assert all(out[i].kept for i in range(900)) and not any(out[1000 + i].kept for i in range(90))
    vote = op.votes()
    first = op.counts(frame(spark, rows)).select("doc_id", (op.posterior(vote, op.start()) >= 0.5).alias("kept")).collect()
    assert {x.doc_id for x in first if x.kept != out[x.doc_id].kept}


def test_variety_reads_the_whole_text(spark):
    prose = lambda k: " ".join(f"word{i}" for i in range(k))
    r = random.Random(5)
    dull = lambda k: " ".join(r.choice(["salt", "pepper", "vinegar"]) for _ in range(k))
    rows = {1: prose(400) + " " + dull(4000), 2: dull(400) + " " + prose(4000), 3: prose(4401), 4: dull(401), 5: prose(1), 6: ""}
    w = {i: WORD.findall(t) for i, t in rows.items()}
    want = {i: sum(len(set(x[k : k + 400])) for k in range(0, len(x), 400)) for i, x in w.items()}
    at = list(op.RULES).index("variety")
    out = op.counts(frame(spark, list(rows.items()))).select("doc_id", "_q_n_distinct", op.votes()[at].alias("vote")).collect()
    assert {x.doc_id: x._q_n_distinct for x in out} == want
    assert [v for _, v in sorted((x.doc_id, x.vote) for x in out)][:5] == [-1, 1, 1, -1, 1]


def test_nothing_to_judge(spark):
    df = frame(spark, [])
    assert op.judge(df).collect() == [] and op.keep(df).collect() == []
    assert op.keep(frame(spark, [(1, None), (2, "a b")])).collect() == []
