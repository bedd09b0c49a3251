import random

import numpy as np
import pytest

from galleon.operators import evidence as op

SCHEMA = "person_id long, media_id long, track_id long, face_id long, vec array<double>, quality double, detection double, usable boolean"


def faces(seed, people=60, dim=8, spread=0.25):
    r, g = random.Random(seed), np.random.default_rng(seed)
    base = [g.normal(size=dim) for _ in range(12)]
    out = []
    for p in range(people):
        c = r.choice(base) + g.normal(size=dim) * 0.5
        for _ in range(r.randint(0, 15)):
            out.append((p, r.randint(1, 6), r.choice([None, 1, 2]), len(out), (c + g.normal(size=dim) * spread).tolist(), r.choice([0.2, 0.5, 0.8]), r.choice([0.6, 0.9]), r.random() < 0.95))
    return out


def brute(rows, threshold, separate, together, checked, shown):
    best = {}
    for p, m, t, f, v, q, d, ok in rows:
        if q >= 0.4 and d >= 0.7:
            key = (p, m, t if t is not None else -f)
            if key not in best or (-q, -d, f) < best[key][0]:
                best[key] = ((-q, -d, f), v, ok)
    crops = {}
    for (p, _, _), (order, v, ok) in sorted(best.items(), key=lambda x: (x[0][0], x[1][0][0], x[1][0][2])):
        crops.setdefault(p, []).append((v, ok))
    crops = {p: np.array([np.array(v) / np.linalg.norm(v) for v, ok in x[:12] if ok]) for p, x in crops.items()}
    crops = {p: x for p, x in crops.items() if len(x)}
    centre = {p: x.mean(0) / np.linalg.norm(x.mean(0)) for p, x in crops.items()}
    out = []
    for a in sorted(crops):
        for b in sorted(crops):
            if a < b:
                cross = np.sort((crops[a] @ crops[b].T).ravel())[::-1]
                c, x = float(centre[a] @ centre[b]), float(cross[0])
                if c >= max(0.4, threshold - 0.08) or x >= max(0.5, threshold + 0.02):
                    out.append((-(0.6 * x + 0.4 * c), a, b, float(cross[:3].mean())))
    kept = [(a, b, -s, t) for s, a, b, t in sorted(out)[:checked] if (a, b) not in separate and (a, b) not in together]
    return kept[:shown], len(crops)


@pytest.mark.parametrize(("seed", "checked", "lists", "block"), [(0, 25, 6, 5), (1, 4000, 3, 1000)])
def test_equal_to_all_pairs(spark, seed, checked, lists, block):
    rows = faces(seed)
    first = brute(rows, 0.6, set(), set(), checked, 10**6)[0]
    separate, together = {x[:2] for x in first[1:9:3]}, {x[:2] for x in first[2:9:3]}
    want, people = brute(rows, 0.6, separate, together, checked, 15)
    pairs = lambda x: spark.createDataFrame(list(x), "a long, b long")
    got = op.suggest(spark.createDataFrame(rows, SCHEMA), 0.6, pairs({(b, a) for a, b in separate}), pairs(together), checked, 15, lists, block)
    out = got.pairs.orderBy("score", ascending=False).collect()
    assert [(r.a, r.b) for r in out] == [x[:2] for x in want]
    assert [r.score for r in out] == pytest.approx([x[2] for x in want]) and [r.top3 for r in out] == pytest.approx([x[3] for x in want])
    assert got.counts["people_with_crops"] == people and got.counts["marked_separate"] == len(separate) and got.counts["same_frame"] == len(together)


def test_far_fewer_are_compared(spark):
    """People in tight groups: bounds leave a few of all pairs."""
    g = np.random.default_rng(5)
    base = g.normal(size=(40, 16))
    rows = [(p, f, None, p * 3 + f, (base[p % 40] + g.normal(size=16) * 0.15).tolist(), 0.9, 0.9, True) for p in range(240) for f in range(3)]
    none = spark.createDataFrame([], "a long, b long")
    got = op.suggest(spark.createDataFrame(rows, SCHEMA), 0.6, none, none, 50, 20)
    want, _ = brute(rows, 0.6, set(), set(), 50, 20)
    assert {(r.a, r.b) for r in got.pairs.collect()} == {x[:2] for x in want}
    assert got.counts["pairs_compared"] < got.counts["pairs"] / 5


def test_nobody(spark):
    none = spark.createDataFrame([], "a long, b long")
    got = op.suggest(spark.createDataFrame([], SCHEMA), 0.6, none, none)
    assert got.pairs.count() == 0 and got.counts["pairs_compared"] == 0


def test_a_task_keeps_only_the_best_pairs():
    """Forty equal people and a stranger: of 780 pairs at one score a block gives the five least, not all."""
    import pyarrow as pa

    n, same, other = 41, [1.0, 0.0], [0.0, 1.0]
    vec = [same] * (n - 1) + [other]
    block = pa.table({"list": [0] * n, "part": [0] * n, "slice": [0] * n, "side": [0] * n, "person_id": list(range(n))[::-1], "embedding": vec, "radius": [0.0] * n, "crops": [[v] for v in vec]})
    got = op._meet(0.4, 0.5, -1.0, True, 5)(block).to_pylist()
    assert [(r["a"], r["b"]) for r in got[:-1]] == [(1, b) for b in range(2, 7)] and got[-1]["compared"] == 780


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_slices_and_chunks_lose_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(op, "VISITORS", 9)
    monkeypatch.setattr(op, "CELLS", 400)
    monkeypatch.setattr(op, "SENT", 3)
    monkeypatch.setattr(op, "DENSE", dense)
    rows = faces(2)
    want, _ = brute(rows, 0.6, set(), set(), 30, 30)
    none = spark.createDataFrame([], "a long, b long")
    got = op.suggest(spark.createDataFrame(rows, SCHEMA), 0.6, none, none, 30, 30, 4, 6).pairs.orderBy("score", ascending=False).collect()
    assert [(r.a, r.b) for r in got] == [x[:2] for x in want] and [r.score for r in got] == pytest.approx([x[2] for x in want])
