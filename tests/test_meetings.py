import math

import numpy as np
import pytest

from galleon.operators import identity, meetings

SCHEMA = "person_id long, media_id long, timestamp double, cx double, cy double, size double"


def brute(rows):
    found, nothing = set(), lambda z: -1.0 if z is None else z
    for p, m, t, x, y, z in rows:
        for q, n, u, v, w, s in rows:
            if None in (p, q, t, u, x, y, v, w) or not p < q or m != n or not 0 < abs(t - u) <= 12:
                continue
            sizes = nothing(z), nothing(s)
            far = math.hypot(x - v, y - w)
            if any(map(math.isnan, sizes)) or far <= 0.6 * max(sizes):
                found.add((p, q))
    return found


@pytest.mark.parametrize("people", [2048, 7])
def test_cells_of_people_meet_as_all_faces_do(spark, monkeypatch, people):
    """However people are cut into cells and videos into slices; with missing, infinite and undefined values."""
    monkeypatch.setattr(meetings, "PEOPLE", people)
    monkeypatch.setattr(meetings, "SLICE", 50)
    r = np.random.default_rng(people)
    inf, nan = float("inf"), float("nan")
    rows = [(int(r.integers(60)) - 9, int(r.integers(4)), float(r.integers(200)) / 4, float(r.normal(int(r.integers(5)) * 40, 3)), float(r.integers(400)) / 4, float(r.integers(1, 40)) / 3) for _ in range(500)]
    for i, (c, odd) in enumerate([(5, None), (5, inf), (5, nan), (5, -2.0), (5, 0.0), (3, nan), (3, inf), (3, -inf), (4, nan), (4, inf), (2, nan), (2, inf), (2, None), (3, None), (4, None), (0, None), (1, None)]):
        rows[i] = (*rows[i][:c], odd, *rows[i][c + 1 :])
    found = identity.tracker_splits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(set(found)) > 100 and {tuple(x) for x in found} == brute(rows)


def test_nobody_meets_nobody(spark):
    assert identity.tracker_splits(spark.createDataFrame([], SCHEMA)).collect() == []
    assert identity.tracker_splits(spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 9.0)], SCHEMA)).collect() == []


def test_people_who_meet_often_are_not_shuffled_pair_by_pair(spark):
    """79,800 pairs meet some 70 times each: what is shuffled follows the 24,000 faces, not their pairs."""
    faces = spark.range(24_000).selectExpr("id % 400 AS person_id", "cast(id / 400 AS long) % 20 AS media_id", "cast(xxhash64(id) % 16 AS double) AS timestamp", "0.0D AS cx", "cast(id % 7 AS double) AS cy", "40.0D AS size").repartition(16).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert identity.tracker_splits(faces).count() == 400 * 399 // 2
    assert written() - before < 3e6
