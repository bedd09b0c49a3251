import random

import numpy as np
import pytest

from galleon.operators import reconcile as op

SCHEMA = "face_id long, person_id long, media_id long, timestamp double, vec array<double>, quality double"


def brute(faces, threshold, protected, apart):
    total, members, seen = {}, {}, set()
    for f, p, _, _, v, q in faces:
        if p is not None:
            total[p] = total.get(p, 0) + max(0.15, q or 0) * np.array(v)
            members.setdefault(p, []).append(f)
    for _, p, m, t, _, _ in faces:
        for _, r, m2, t2, _, _ in faces:
            if None not in (p, r) and p != r and m == m2 and (t is None or t2 is None or abs(t - t2) <= 0.001):
                seen.add((p, r))
    seen |= {(a, b) for a, b in apart} | {(b, a) for a, b in apart}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    free = sorted(p for p in total if p not in protected)
    group = {p: p for p in free}
    for _ in free:
        for a in free:
            for b in free:
                if a != b and cos(total[a], total[b]) >= threshold - 1e-6:
                    group[a] = group[b] = min(group[a], group[b])
    merges, noise = [], []
    for g in sorted(set(group.values())):
        people = [p for p in free if group[p] == g]
        if len(people) == 1:
            noise += [(members[g][0], g)] if len(members[g]) == 1 else []
            continue
        s, inside = total[g].copy(), {g}
        for p in people[1:]:
            if cos(s, total[p]) >= threshold and not any((p, x) in seen for x in inside):
                s = s + total[p]
                inside.add(p)
                merges.append((p, g))
        total[g] = s
    return sorted(merges), sorted(noise), {p: total[p] for p in total if p not in {m for m, _ in merges}}


def scene(seed, people=50, dim=4):
    r, g = random.Random(seed), np.random.default_rng(seed)
    base = [g.normal(size=dim) for _ in range(4)]
    out = []
    for p in range(people):
        centre = r.choice(base) + g.normal(size=dim) * 0.45
        for _ in range(r.choice([1, 1, 2, 3])):
            v = centre + g.normal(size=dim) * 0.1
            out.append((len(out), p, r.randint(0, 40), r.choice([None, 1.0, 2.0]), (v / np.linalg.norm(v)).tolist(), r.choice([None, 0.1, 0.7])))
    out.append((9999, None, 1, None, [1.0] + [0.0] * (dim - 1), 0.5))
    return out, {r.randrange(people) for _ in range(4)}, {tuple(sorted(r.sample(range(people), 2))) for _ in range(10)}


@pytest.mark.parametrize(("seed", "block"), [(0, 5), (1, 1000)])
def test_against_brute_force(spark, seed, block):
    faces, protected, apart = scene(seed)
    want = brute(faces, 0.85, protected, apart)
    got = op.reconcile(spark.createDataFrame(faces, SCHEMA), 0.85, spark.createDataFrame([(p,) for p in protected], "person_id long"), spark.createDataFrame(list(apart), "a long, b long"), block)
    assert sorted(map(tuple, got[0].collect())) == want[0] and len(want[0]) > 7
    assert sorted(map(tuple, got[1].collect())) == want[1]
    centres = {r.person_id: r["sum"] for r in got[2].collect()}
    assert set(centres) == set(want[2]) and all(centres[p] == pytest.approx(list(v)) for p, v in want[2].items())


def test_edges(spark):
    none = op.reconcile(spark.createDataFrame([], SCHEMA), 0.5, spark.createDataFrame([], "person_id long"))
    assert [x.count() for x in none] == [0, 0, 0]


def test_groups_of_many_are_tried_without_pairs(spark, monkeypatch):
    """Three thousand look-alikes of one item, most at one of three times: few can be one, and no pair of them is listed."""
    monkeypatch.setattr(op, "STEP", 64)
    n = 3000
    times = [None, 1.0, 2.0, 2.0005, 3.0009, 3.0, float("inf")]
    faces = [(i, i, 5 if i % 50 else i, times[i % 3 + 1] if i % 100 else times[i // 100 % 7], [1.0, 0.001 * (i % 7)], 0.5) for i in range(n)]
    shown = spark.createDataFrame(faces, SCHEMA)
    met, want = [faces[0]], []
    for f in faces[1:]:
        if not any(f[2] == g[2] and (f[3] is None or g[3] is None or abs(f[3] - g[3]) <= 0.001) for g in met):
            met.append(f)
            want.append((f[1], 0))
    nobody = spark.createDataFrame([], "person_id long")
    for block in (700, 100_000):
        got = op.reconcile(shown, 0.9, nobody, block=block)[0]
        assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_sights():
    one = op._Sights()
    one.add([(1, 2.0), (2, None), (3, float("inf")), (4, 1.0), (4, 5.0)])
    assert [one.meets([s]) for s in ((1, 2.001), (1, 2.1), (1, None), (2, 9.0), (3, float("inf")), (3, None), (4, 4.9995), (4, 3.0), (5, None))] == [True, False, True, True, False, True, True, False, False]
