import random

import numpy as np
import pytest

from galleon.llm import _words as W
from galleon.llm import substring_dedup as op

from .samples import WORD, documents, frame, thue_morse


def brute(rows, k=13):
    inf = float("inf")
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, inf), inf if i is None else i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (inf if i is None else i):
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = documents(seed)
    rows += random.Random(seed).sample(rows, 2)  # repeated rows
    found = sorted(map(tuple, op.deduplicate(frame(spark, rows)).collect()), key=str)
    assert found == brute(rows)


def test_words_written_to_collide(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*words[:9], thue_morse(11, i % 2 > 0), *words[9:]])) for i in range(4)] + [(9, " ".join(words))]
    assert sorted(map(tuple, op.deduplicate(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_a_document_larger_than_a_slice(spark):
    r = random.Random(4)
    long = " ".join(r.choice("abcdefgh") * r.randint(1, 6) + str(r.randint(0, 10**4)) for _ in range(350_000))
    rows = [(2, long), (1, long[:5000]), (3, long[1_500_000:2_600_000]), (4, "x " + long)]
    assert sorted(map(tuple, op.deduplicate(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_pairs_of_hashes():
    """Equal first halves are told apart by the second."""
    r = np.random.default_rng(0)
    h, g = r.integers(0, 4, 60).astype(np.uint64), r.integers(0, 4, 60).astype(np.uint64)
    order, start = W.order2(h, g)
    pairs = list(zip(h[order][start].tolist(), g[order][start].tolist(), strict=True))
    assert pairs == sorted(set(zip(h.tolist(), g.tolist(), strict=True)))
    assert [order[i] for i in start] == [min(j for j in range(60) if (h[j], g[j]) == p) for p in pairs]
    at = W.find2(h[order][start], g[order][start], h, g)
    assert [pairs[i] for i in at] == list(zip(h.tolist(), g.tolist(), strict=True))


def test_empty_table(spark):
    assert op.deduplicate(frame(spark, [])).collect() == []


def test_covers_are_difference_covers():
    for p, cover in op.COVERS.items():
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))
