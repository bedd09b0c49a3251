"""Vectors in lists, and rules over crops and frames, against plain Python."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galleon.functions import scalars as X
from galleon.operators import ann, crops, identity, library, sequences
from galleon.streaming import incremental


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def clusters(n=600, dim=16, groups=30, seed=0):
    r = np.random.default_rng(seed)
    return unit(r.normal(size=(groups, dim))[r.integers(0, groups, n)] + 0.35 * r.normal(size=(n, dim)))


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("threshold,lists,block", [(0.9, 20, 50), (0.6, 8, 2048), (0.8, 1, 64), (0.97, None, 16)])
def test_join_in_lists_is_exact(spark, threshold, lists, block):
    v = clusters()
    v[7] = v[8]
    v = unit(v.astype(np.float32).astype(float))
    sim = v @ v.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(sim >= threshold, 1)), strict=True)}
    found = [(r.a, r.b) for r in ann.similarity_join(frame(spark, v), threshold, lists, block_rows=block).collect()]
    assert len(found) == len(set(found)) and set(found) == want and (7, 8) in want


@pytest.mark.parametrize("visitors,lists,block", [(50, 20, 50), (7, 1, 64), (200, 8, 2048)])
def test_join_in_lists_is_exact_in_slices_of_visitors(spark, visitors, lists, block):
    v = unit(clusters().astype(np.float32).astype(float))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.6, 1)), strict=True)}
    found = [(r.a, r.b) for r in ann.similarity_join(frame(spark, v), 0.6, lists, block_rows=block, visitors=visitors).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_approximate_neighbours_reach_their_recall(spark):
    v = clusters(900)
    rows = frame(spark, v)
    index = ann.build(rows, lists=30)
    queries = rows.where("vec_id % 20 = 0")
    probes = ann.tune(index, queries, rows, 10, 0.95)
    found = ann.search(index, queries, 10, probes).collect()
    sim = v @ v.T
    np.fill_diagonal(sim, -9)
    exact = {(i, int(j)) for i in range(0, 900, 20) for j in np.argsort(-sim[i])[:10]}
    assert len(exact & {(r.a, r.b) for r in found}) >= 0.9 * len(exact)
    every = ann.search(index, queries, 10, 30).collect()
    assert {(r.a, r.b) for r in every} == exact


@pytest.mark.parametrize("limit", [10, 10_000])
def test_filtered_neighbours(spark, limit):
    v = clusters(500)
    rows = frame(spark, v)
    index = ann.build(rows, lists=40)
    allowed = [i for i in range(500) if i % 3 == 0]
    found = [r.id for r in ann.filtered(index, rows, rows.where("vec_id % 3 = 0"), v[4].tolist(), 5, exact_limit=limit).orderBy(F.desc("similarity")).collect()]
    best = sorted(allowed, key=lambda i: -(v[i] @ v[4]))[:5]
    assert len(set(found) & set(best)) >= 4 and set(found) <= set(allowed)


def test_filtered_neighbours_are_exact_where_lists_say_little(spark):
    v = unit(np.random.default_rng(5).normal(size=(400, 12)).astype(np.float32).astype(float))
    rows = frame(spark, v)
    index, allowed = ann.build(rows, lists=40), rows.where("vec_id % 2 = 1")
    for at in (0, 2):
        found = [r.id for r in ann.filtered(index, rows, allowed, v[at].tolist(), 10, exact_limit=10).orderBy(F.desc("similarity")).collect()]
        assert found == sorted(range(1, 400, 2), key=lambda i: -(v[i] @ v[at]))[:10]


def test_keyframes_and_samples(spark):
    r = random.Random(1)
    rows = [(m, round(k * 0.25, 2), r.choice([0.0, 0.1, 0.5]), r.choice([0.0, 0.05, 0.2, None])) for m in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "media_id long, t double, scene double, diff double")
    want, last = [], {}
    for m, t, scene, _ in rows:
        if m not in last or t - last[m] >= 30 or (scene > 0.3 and t - last[m] >= 1):
            want.append((m, t))
            last[m] = t
    assert sorted(map(tuple, crops.keyframes(df).collect())) == want
    want, due, seen = [], {}, set()
    for m, t, _, diff in rows:
        if t + 1e-6 >= due.get(m, 0):
            want.append((m, t))
            step = 3.0
            if m in seen and diff is not None:
                step = max(1.0, 1.2) if diff > 0.08 else min(6.0, 5.4) if diff < 0.015 else 3.0
            seen.add(m)
            due[m] = t + step
    assert sorted(map(tuple, crops.adaptive_samples(df, 3.0).collect())) == want


def test_redetections(spark):
    schema = "media_id long, id long, timestamp double, bbox array<double>, embedding array<double>"
    old = [(1, 1, None, [0.0, 0.0, 10.0, 10.0], [1.0, 0.0]), (1, 2, None, [1.0, 0.0, 10.0, 10.0], [1.0, 0.0]), (1, 3, 5.0, [0.0, 0.0, 10.0, 10.0], [1.0, 0.0])]
    new = [(1, 10, None, [1.0, 0.0, 10.0, 10.0], [1.0, 0.0]), (1, 11, None, [0.0, 0.0, 10.0, 10.0], [1.0, 0.0]), (1, 12, 5.0005, [0.0, 0.0, 10.0, 10.0], [0.0, 1.0]), (2, 13, None, [0.0, 0.0, 1.0, 1.0], [1.0, 0.0]), (1, 14, None, [0.0, 0.0, 10.0, 10.0], [1.0, 0.0])]
    found = {r.id: r.old_id for r in crops.redetections(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), 0.5).collect()}
    assert found == {10: 2, 11: 1, 12: None, 13: None, 14: None}


def test_redetections_of_a_long_video_need_no_square_of_it(spark):
    """A task may not hold all pairs of a video's faces: 8,000 old and 8,000 new would be 512 MB for one array of scores."""
    d = spark.range(16_000).selectExpr("1L AS media_id", "id", "CASE WHEN id % 50 > 1 THEN cast(floor(id / 8) AS double) END AS timestamp", "array(id % 3 * 2.0D, 0.0D, 20.0D, 20.0D) AS bbox", "array(cos(id % 5), sin(id % 5)) AS embedding")
    rows, want, used = d.collect(), {}, set()
    old, new = (sorted((r for r in rows if r.id % 2 == k), key=lambda r: r.id) for k in (0, 1))
    by = {}
    for r in old:
        by.setdefault(r.timestamp, []).append(r)
    for r in new:
        x = [(sequences.box_iou(r.bbox, a.bbox) + np.dot(r.embedding, a.embedding), -a.id) for a in by.get(r.timestamp, []) if a.id not in used and sequences.box_iou(r.bbox, a.bbox) >= 0.55 and np.dot(r.embedding, a.embedding) >= 0.5] if r.timestamp is not None else []
        want[r.id] = -max(x)[1] if x else None
        used.add(want[r.id])
    tracemalloc.start()
    pdf = d.withColumn("known", F.expr("id % 2 = 0")).toPandas()
    before = tracemalloc.get_traced_memory()[0]
    found = crops.pick_redetections(pdf, "media_id", 0.5, 0.001, 0.55)
    assert tracemalloc.get_traced_memory()[1] - before < 100e6
    tracemalloc.stop()
    got = {k: None if pd.isna(v) else int(v) for k, v in zip(found["id"], found["old_id"], strict=True)}
    assert all(got[k] == v for k, v in want.items() if rows[k].timestamp is not None) and sum(v is not None for v in want.values()) > 1000


def test_track_edges(spark):
    tracks = spark.createDataFrame([(1, 1, 10.0, 20.0, [1.0, 0.0]), (1, 2, 10.0, 20.0, [0.8, 0.6])], "media_id long, track long, first_ts double, last_ts double, vec array<double>")
    probes = [(1, 1, 9.0, [1.0, 0.0], 0.9), (1, 2, 9.0, [0.0, 1.0], 0.9), (1, 3, 21.0, [1.0, 0.0], 0.1), (1, 4, 15.0, [1.0, 0.0], 0.9), (1, 5, 8.0, [0.9, 0.1], 0.9)]
    df = spark.createDataFrame(probes, "media_id long, id long, ts double, vec array<double>, quality double")
    assert sorted((r.track, r.id) for r in crops.track_edges(tracks, df).collect()) == [(1, 1), (1, 5), (2, 2)]


def test_distinct_crops_and_references(spark):
    r = np.random.default_rng(4)
    rows = []
    for p in (1, 2):
        base = unit(r.normal(size=(12, 8)))
        for k in range(60):
            v = unit(base[k % 12] + (0.01 if k % 3 else 0.3) * r.normal(size=8))
            rows.append((p, p * 100 + k, k, v.tolist(), float(r.uniform())))
    df = spark.createDataFrame(rows, "person_id long, face_id long, seq long, embedding array<double>, quality double")
    want, held = set(), set()
    for p in (1, 2):
        mine = [x for x in rows if x[0] == p]
        kept = []
        for x in sorted(mine, key=lambda x: (-x[4], x[1]))[:20]:
            if len(kept) < 10 and all(np.dot(x[3], y[3]) < 0.97 for y in kept):
                kept.append(x)
        want |= {x[1] for x in kept}
        views = []
        for x in mine:
            twin = [i for i, y in enumerate(views) if np.dot(x[3], y[3]) >= 0.98]
            if twin:
                if x[4] > views[twin[0]][4]:
                    views[twin[0]] = x
            else:
                views = sorted([*views, x], key=lambda y: -y[4])[:6]
        held |= {x[1] for x in views}
    assert {x.face_id for x in crops.distinct_crops(df, 10).collect()} == want
    assert {x.face_id for x in crops.references(df).collect()} == held


def people_of(spark, seed=3, names=None):
    """Six true people, each cut into two or three, and two look-alikes seen together."""
    r = np.random.default_rng(seed)
    rows, pid, truth = [], 0, {}
    for true in range(6):
        centre = unit(r.normal(size=32))
        for _ in range(2 + true % 2):
            pid += 1
            truth[pid] = true
            for k in range(5):
                v = unit(centre + 0.09 * r.normal(size=32))
                rows.append((pid, pid * 10 + k, pid * 100 + k, None, 10.0 * k, 5.0, 40.0, v.tolist(), float(r.uniform(0.4, 1))))
    c = spark.createDataFrame(rows, "person_id long, face_id long, media_id long, timestamp double, cx double, cy double, size double, embedding array<double>, quality double")
    p = spark.createDataFrame([(i, (names or {}).get(i), 5 + i) for i in truth], "id long, name string, face_count long")
    return c, p, truth


def groups(merges, ids):
    up = {i: i for i in ids}
    for m in sorted(merges, key=lambda m: (m.component, m.step)):
        up = {i: m.target if j == m.source else j for i, j in up.items()}
    return up


def test_automatic_identity(spark):
    c, p, truth = people_of(spark)
    seen = c.select("person_id", "media_id", "timestamp")
    apart = spark.createDataFrame([], "a long, b long")
    up = groups(crops.auto_identity(c, p, seen, apart).collect(), truth)
    assert all((up[i] == up[j]) == (truth[i] == truth[j]) for i, j in itertools.combinations(truth, 2))
    first = {m.component: (m.source, m.target) for m in crops.auto_identity(c, p, seen, apart).collect() if m.step == 1}
    assert all(s < t for s, t in first.values())  # the larger stays
    # pairs kept apart, different names and shared frames bar a merge
    same = [[i for i in truth if truth[i] == t] for t in (0, 2, 4)]
    c, p, _ = people_of(spark, names={same[1][0]: "Ann", same[1][1]: "Bob", same[0][0]: "Cid"})
    seen = seen.unionByName(spark.createDataFrame([(i, 99, None) for i in same[2]], seen.schema))
    apart = spark.createDataFrame([(same[0][0], same[0][1])], "a long, b long")
    up = groups(crops.auto_identity(c, p, seen, apart).collect(), truth)
    assert all(up[s[0]] != up[s[1]] for s in same)


def test_impostor_floors(spark):
    c, _, truth = people_of(spark)
    seen = c.select("person_id", "media_id", "timestamp")
    assert crops.impostor_floors(c, seen) == crops.LEVELS["balanced"]
    together = spark.createDataFrame([(i, 5000 + k, None) for k, pair in enumerate(itertools.combinations(truth, 2)) if truth[pair[0]] == truth[pair[1]] for i in pair], seen.schema)
    floors = crops.impostor_floors(c, together)
    assert all(f == 0.78 for f in floors)


def test_moments_signals_and_phrases(spark):
    v = clusters(60)
    df = spark.createDataFrame([(i, i % 4, i / 3, x.tolist()) for i, x in enumerate(v)], "id long, media_id long, t double, embedding array<double>")
    found = crops.video_moments(df, v[5].tolist(), limit=6, per_video=2).collect()
    want, per = [], {}
    for i in sorted(range(60), key=lambda i: -(v[i] @ v[5])):
        if per.get(i % 4, 0) < 2 and len(want) < 6:
            want.append(i)
            per[i % 4] = per.get(i % 4, 0) + 1
    assert [r.id for r in found] == want
    some = crops.video_moments(df, v[5].tolist(), spark.createDataFrame([(1,)], "media_id long"))
    assert {r.media_id for r in some.collect()} == {1}
    s = spark.createDataFrame([("text", 1, 0.4), ("recency", 1, 0.9), ("vector", 1, 0.5), ("text", 2, 0.1)], "signal string, id long, similarity double")
    assert {tuple(r) for r in crops.best_similarity(s).collect()} == {(1, 0.5), (2, 0.1)}
    assert crops.expansions([" a ", "", "b", "c", "d", "e"]) == {f"expansion_{i}": 0.5 for i in range(4)}


def test_stable_event_ids(spark):
    events = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (9, 0)], "id long, user_edited int")
    current = spark.createDataFrame([(i, e, 0) for e, ids in {1: range(0, 4), 2: range(4, 6), 3: range(6, 9), 9: range(20, 22)}.items() for i in ids], "media_id long, event_id long, locked int")
    found = [(0, 1, i) for i in (0, 4, 5)] + [(0, 2, i) for i in (1, 2, 3)] + [(0, 3, i) for i in (6, 7)] + [(1, 1, i) for i in (20, 21)]
    out = {(r.scope, r.group): (r.event_id, r.changed) for r in library.stable_ids(spark.createDataFrame(found, "scope long, group long, media_id long"), current, events).collect()}
    assert out[0, 1] == (2, True) and out[0, 2] == (1, True) and out[1, 1] == (9, False)
    assert out[0, 3][0] > 9 and out[0, 3][1]


def test_undoing_a_merge(spark):
    faces = spark.createDataFrame([(i, 1 + i % 3) for i in range(9)], "id long, person_id long")
    people = spark.createDataFrame([(1, "A"), (2, None), (3, "C")], "id long, name string")
    ex = spark.createDataFrame([(1, 5), (2, 5), (1, 6), (3, 5)], "person_id long, media_id long")
    rej = spark.createDataFrame([(10, 1), (10, 2)], "face_id long, person_id long")
    done = library.merge_people(faces, people, ex, rej, 1, 2)
    rows = lambda df: sorted(map(str, df.collect()))
    assert {r.person_id for r in done["faces"].collect()} == {2, 3} and {(r.id, r.name) for r in done["people"].collect()} == {(2, "A"), (3, "C")}
    assert sorted((r.person_id, r.media_id) for r in done["exclusions"].collect()) == [(2, 5), (2, 6), (3, 5)] and done["rejections"].count() == 1
    back = library.undo_merge(done, done, 1, 2)
    assert rows(back["faces"]) == rows(faces) and rows(back["people"]) == rows(people) and rows(back["exclusions"]) == rows(ex) and rows(back["rejections"]) == rows(rej)


GOOD = [[30.0, 40.0], [60.0, 40.0], [45.0, 60.0], [33.0, 80.0], [57.0, 80.0]]
FACES = [
    (GOOD, True),
    (GOOD[:4], False),
    ([*GOOD[:2], [45.0, 120.0], *GOOD[3:]], False),  # the nose below the mouth
    ([[30.0 + i, 40.0 + i] for i in range(5)], False),  # on a line
    ([*GOOD[:4], [57.0, float("nan")]], False),
    ([[-60.0, 40.0], *GOOD[1:]], False),  # far outside the box
    ([[45.0, 40.0], [45.5, 40.0], *GOOD[2:]], False),  # eyes too close
]


def test_landmarks(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(FACES)], "i int, p array<array<double>>")
    box = F.array(*map(F.lit, (15.0, 15.0, 60.0, 80.0)))
    found = df.select("i", X.valid_landmarks(F.col("p"), box, F.lit(100.0), F.lit(None).cast("double")).alias("ok"), X.pose_quality(F.col("p")).alias("pose")).orderBy("i").collect()
    assert [r.ok for r in found] == [ok for _, ok in FACES]
    yaw, pitch = (45 - 45) / (0.85 * 30), (60 - 40 - 0.55 * 30) / (0.9 * 30)
    assert abs(found[0].pose - (1 - 0.55 * abs(yaw) - 0.35 * abs(pitch))) < 1e-9


def test_names_shares_and_phrases(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    share = lambda s: (lambda r: r and (r.server, r.share))(get(X.share_parts(F.lit(s))))
    assert share("//me@NAS/photos/a%20b/") == ("nas", "photos/a b") and share("nas:/export/x") == ("nas", "/export/x")
    assert share("\\\\\\\\NAS\\\\pics") == ("nas", "pics") and share("https://Host/a/b") == ("host", "a/b") and share("plain") is None
    assert share("\\\\NAS\\pics\\2024") == ("nas", "pics/2024")  # as Windows writes it
    rel = lambda r, p: get(X.relative_identity(F.lit(r), F.lit(p)))
    assert rel("/Lib/", "/lib/A. /B.JPG") == "a/b.jpg" and rel("/lib", "/other/x") is None and rel("/lib", "/lib") is None
    assert rel("\\\\Nas\\Pics", "\\\\nas\\pics\\A\\b.jpg") == "a/b.jpg" == rel("C:\\Pics", "c:\\pics\\A\\b.jpg")
    raw = "Here you go:\n1. A photo of a red boat. It sails.\n- \"sunset over the sea\"\n* Sunset over the sea\nword\n3) the old town in winter"
    assert get(X.clean_phrases(F.lit(raw))) == ["a red boat", "sunset over the sea", "the old town in winter"]
    h = "0" * 48
    assert get(X.near_duplicate(F.lit(h * 4), F.lit(h * 2 + "f" * 96))) and not get(X.near_duplicate(F.lit(h * 4), F.lit(h + "f" * 144)))
    assert get(X.near_duplicate(F.lit("0" * 16), F.lit("0" * 14 + "ff"))) and not get(X.near_duplicate(F.lit("0" * 16), F.lit("0" * 48)))
    day = F.lit("2024-02-10 09:00:00").cast("timestamp")
    name = lambda lat, who, place, home: get(X.event_name(day, day, F.lit(lat).cast("double"), F.lit(lat).cast("double"), F.array(*map(F.lit, who)).cast("array<string>"), F.lit(place).cast("string"), F.lit(home).cast("double"), F.lit(home).cast("double")))
    assert name(10.0, ["A", "B", "C"], "Town, X", 10.0) == "With A & B · 10 Feb 2024"
    assert name(10.0, ["A"], "Town, X", 50.0) == "Town · 10 Feb 2024" and name(-10.0, [], None, None) == "10.00°S 10.00°W · 10 Feb 2024"
    assert name(None, ["A"], None, None) == "With A · 10 Feb 2024" and name(None, [], None, None) == "10 Feb 2024"


def test_late_changes_lose(spark, tmp_path):
    """Over several batches the greatest sequence of a key wins, also where it came first."""
    base = spark.createDataFrame([(i, float(i)) for i in range(20)], "key long, v double")
    batches = [[(1, 9.0, 50, False), (2, 0.0, 60, True)], [(1, 8.0, 10, False), (2, 7.0, 20, False), (30, 3.0, 5, False)], [(30, 4.0, 4, False), (3, 5.0, 70, False)]]
    state = {i: (float(i), -1, False) for i in range(20)}
    for n, part in enumerate(batches):
        spark.createDataFrame(part, "key long, v double, seq long, deleted boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "j"))
        j = incremental.watch(spark, str(tmp_path / "j"), "key long, v double, seq long, deleted boolean")
        incremental.apply_journal(j, base, str(tmp_path / "t"), str(tmp_path / "c1"), "key", "seq").awaitTermination()
        incremental.apply_journal_buckets(j, base, str(tmp_path / "b"), str(tmp_path / "c2"), "key", "seq", buckets=8).awaitTermination()
        for k, v, s, d in part:
            if s > state.get(k, (0, -1, 0))[1]:
                state[k] = (v, s, d)
        want = {(k, v) for k, (v, _, d) in state.items() if not d}
        assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t/v{n:09d}").collect()} == want
        assert {tuple(r) for r in incremental.read_buckets(spark, str(tmp_path / "b"), base.columns).collect()} == want
    written = {p.name for p in (tmp_path / "b" / "data").glob("_v=2/*")}
    assert 0 < len([p for p in written if p.startswith("_p=")]) <= 2


def test_tracker_splits_meet_by_place(spark):
    r = np.random.default_rng(3)
    odd = [None, float("inf"), 0.0, -1.0]
    rows = [(int(r.integers(40)), int(r.integers(2)), float(r.integers(200)) / 4, float(r.integers(100)), float(r.integers(100)) / 4, odd[i] if i < 4 else float(r.integers(1, 60)) / 3) for i in range(500)]
    want = set()
    for p, m, t, x, y, z in rows:
        for q, n, u, v, w, s in rows:
            size = max(-1.0 if z is None else z, -1.0 if s is None else s)
            if p < q and m == n and 0 < abs(t - u) <= 12 and math.hypot(x - v, y - w) <= 0.6 * size:
                want.add((p, q))
    found = identity.tracker_splits(spark.createDataFrame(rows, "person_id long, media_id long, timestamp double, cx double, cy double, size double"))
    assert {(x.a, x.b) for x in found.collect()} == want and len(want) > 20
    assert "cell_cx" in found._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_known_of_a_person_may_come_with_any_crop():
    rows = [{"person_id": 1, "faces": 2, "name": None, "apart": a, "seen": s, "face_id": i, "media_id": 1, "timestamp": 0.0, "cx": 0.0, "cy": 0.0, "size": 1.0, "embedding": [1.0, 0.1 * i], "quality": 0.5} for i, a, s in ((1, [], []), (2, [5], [(7, 1.0)]))]
    person = crops.Person(pd.DataFrame(rows))
    assert person.apart == {5} and person.seen == {(7, 1.0)}
