import itertools
import random
import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from galleon.functions import scalars as X
from galleon.operators import changes, events, facets, graph, sequences, sessions, vectors
from galleon.plans.analytics import QUERIES as ANALYTICS
from galleon.sources import files
from galleon.streaming import incremental


def test_assignment_is_least():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 5), (5, 3), (5, 5)]:
        for _ in range(20):
            cost = r.random((n, m))
            got = sequences.assign(cost)
            small = min(n, m)
            best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in zip(range(small), p, strict=True)) for p in itertools.permutations(range(max(n, m)), small))
            assert len(got) == small and abs(sum(cost[i, j] for i, j in got) - best) < 1e-9


def test_tracker_keeps_crossing_people_apart(spark):
    rows, a, b = [], [1.0, 0.0], [0.0, 1.0]
    for t in range(10):
        rows += [(1, 2 * t, float(t), [10.0 * t, 0.0, 20.0, 20.0], a, 0.9), (1, 2 * t + 1, float(t), [90.0 - 10 * t, 0.0, 20.0, 20.0], b, 0.9)]
    df = spark.createDataFrame(rows, "media_id long, id long, ts double, bbox array<double>, vec array<double>, detection double")
    found = {r.id: r.track for r in sequences.track(df).collect()}
    assert len({found[i] for i in range(0, 20, 2)}) == 1 and len({found[i] for i in range(1, 20, 2)}) == 1 and found[0] != found[1]


def test_trips_are_one_event(spark):
    home, away, start, rows = (23.81, 90.41), (21.43, 91.98), datetime(2025, 3, 1, 9), []
    for d in range(20):
        rows += [(start - timedelta(days=60 - d * 2), home)]
    for d in range(3):
        rows += [(start + timedelta(days=d, hours=h), away) for h in range(6)]
    data = [(7, i, t, p[0], p[1], None, None) for i, (t, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "user_id long, event_id long, ts timestamp_ntz, lat double, lon double, vec array<double>, people array<long>")
    found = events.detect(df).collect()
    trip = {(r.super, r.event) for r in found if r.event_id >= 20}
    assert len(trip) == 1 and len(found) == len(rows)
    assert len({(r.super, r.event) for r in found}) == 21


def test_similarity_join_and_components_against_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.6}
    pairs = vectors.similarity_join(df, 0.6, block_rows=17)
    assert {(p.a, p.b) for p in pairs.collect()} == want
    up = list(range(60))
    for _ in range(60):
        for i, j in want:
            up[i] = up[j] = min(up[i], up[j])
    assert {(c.id, c.component) for c in graph.components(pairs).collect()} == {(i, up[i]) for p in want for i in p}
    top = vectors.top_k_join(df, df, 3, block_rows=17).collect()
    for i in range(60):
        s = u @ u[i]
        s[i] = -9
        assert [x.b for x in sorted((x for x in top if x.a == i), key=lambda x: x.rank)] == list(np.argsort(-s)[:3])


def test_active_faces(spark):
    faces = spark.createDataFrame([(1, 1, 5, None, "confirmed"), (2, 1, None, None, "x"), (3, 2, 5, None, "x"), (4, 1, 6, None, "x"), (5, 1, 7, "d", "x"), (6, 1, 8, None, "rejected"), (7, 1, 9, None, "x")], "id long, media_id long, person_id long, deleted_at string, review_state string")
    media = spark.createDataFrame([(1, None, 0), (2, None, 1)], "id long, deleted_at string, missing int")
    exclusions = spark.createDataFrame([(6, 1)], "person_id long, media_id long")
    rejections = spark.createDataFrame([(7, 9)], "face_id long, person_id long")
    assert {r.id for r in facets.active(faces, media, exclusions, rejections).collect()} == {1, 2}


def test_wildcards_are_literal(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("A_B",)], "t string")
    assert {r.t for r in df.where(facets.contains(F.col("t"), "a%b")).collect()} == {"a%b"}
    assert {r.t for r in df.where(facets.contains(F.col("t"), "a%b", raw_wildcards=True)).collect()} == {"a%b", "axb", "A_B"}
    with pytest.raises(ValueError):
        facets.in_bbox(F.col("a"), F.col("b"), 10, 0, -10, 0)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(X.hamming64(F.lit("f" * 16), F.lit("0" * 16))) == 64 and get(X.hamming64(F.lit("z"), F.lit("0" * 16))) == 64
    assert get(X.iso6709(F.lit("+48.85+002.35/"))).lat == 48.85 and get(X.iso6709(F.lit("+0.0+0.0/"))) is None
    assert get(X.dms_degrees(F.array(F.lit(10.0), F.lit(30.0), F.lit(36.0)), F.lit("s"))) == -10.51
    assert get(X.safe_path(F.lit("a/b:c. "))) == "a_b_c" and get(X.safe_path(F.lit(" . "))) == "Unknown"
    assert get(X.scrub(F.lit("/home/me/x a@b.co"))) == "/home/***/x ***"
    assert get(X.ignored(F.lit("a/b/c.tmp"), ["*.tmp"])) and get(X.ignored(F.lit("a/b"), ["a/"])) and not get(X.ignored(F.lit("ab/c"), ["a"]))
    assert get(X.edit_rotation(F.lit(-90))) == 270 and get(X.edit_rotation(F.lit(45))) is None


def test_scan_and_export(spark, tmp_path):
    for name, size in [("a/x.JPG", 3), ("a/._x.jpg", 3), ("b/y.mp4", 5), ("b/z.txt", 1), ("b/e.png", 0), ("c/skip/k.png", 2)]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
    found = {(r.path.rsplit("/", 1)[1], r.kind, r.size) for r in files.scan(spark, str(tmp_path), ["skip"]).collect()}
    assert found == {("x.JPG", "photo", 3), ("y.mp4", "video", 5)}


def test_nearest_place(spark):
    r = random.Random(0)
    cities = [(f"c{i}", r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(3000)] + [("edge", 10.0, 179.95)]
    points = [(i, r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(100)] + [(1000, 10.0, -179.95)]
    c = spark.createDataFrame(cities, "name string, lat double, lon double")
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    found = {x.id: x.name for x in files.nearest_place(p, c, "id", 60.0).collect()}
    for i, lat, lon in points:
        km, name = min((events.km((lat, lon), (a, o)), n) for n, a, o in cities)
        assert found.get(i) == (name if km <= 60 else None)


def test_backup_problems(spark):
    data = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"22")), ("c", bytearray(b"3"))], "path string, content binary")
    good = data.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    manifest = good.where("path = 'a'").unionByName(spark.createDataFrame([("b", 9, "x"), ("d", 1, "x")], good.schema))
    assert {(r.path, r.problem) for r in files.verify_backup(manifest, data).collect()} == {("b", "size"), ("c", "unlisted"), ("d", "missing")}


def test_package_round_trip(spark, tmp_path):
    people = spark.createDataFrame([(1, "A"), (2, None)], "id long, name string")
    m = files.write_package({"people": people, "none": people.limit(0)}, str(tmp_path / "p"))
    assert {(r.table, r.n_rows) for r in m.collect()} == {("people", 2), ("none", 0)}
    assert sorted(files.read_package(spark, str(tmp_path / "p"), "people", people.schema).collect()) == sorted(people.collect())


def test_debounce_and_journal(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [("a", t, 1), ("a", t + timedelta(milliseconds=500), 2), ("a", t + timedelta(seconds=5), 2), ("b", t, 1), ("end", t + timedelta(hours=1), 1)]
    df = spark.createDataFrame(rows, "path string, ts timestamp, size long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = incremental.watch(spark, str(tmp_path / "in"), "path string, ts timestamp, size long")
    out = incremental.collect_once(incremental.debounce(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.path, r.n, r.stable) for r in out.collect()} == {("a", 2, False), ("a", 1, True), ("b", 1, True)}
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "key long, v double")
    for i, part in enumerate([[(1, 9.0, 1, False)], [(2, 0.0, 2, True), (3, 3.0, 3, False), (3, 4.0, 4, False)]]):
        spark.createDataFrame(part, "key long, v double, seq long, deleted boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "j"))
        j = incremental.watch(spark, str(tmp_path / "j"), "key long, v double, seq long, deleted boolean")
        incremental.apply_journal(j, base, str(tmp_path / "t"), str(tmp_path / "jc"), "key", "seq").awaitTermination()
        last = spark.read.parquet(f"{tmp_path}/t/v{i:09d}")
    assert {tuple(r) for r in last.collect()} == {(1, 9.0), (3, 4.0)}


def test_session_gaps(spark):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, i, t + timedelta(minutes=m)) for i, m in enumerate([0, 30, 90, 91])], "user_id long, event_id long, ts timestamp_ntz")
    assert [r.session for r in sessions.sessions(df, 0.5).orderBy("event_id").collect()] == [1, 1, 2, 2]


def test_strikes(spark):
    one = spark.range(1)
    s = lambda n, net: one.select(changes.strike(F.lit(True), F.lit(n), net).alias("x")).first().x
    assert [s(0, False), s(0, True), s(1, True), s(2, True)] == [2, 1, 2, 2]


def test_scaled_round_is_that_of_sql(spark):
    values = [i / 2000 for i in range(2001)] + [-0.575, 2.5, -2.5, None, 8580000309.125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*(X.scaled_round(F.col("v"), d) for d in (0, 2, 6))).collect()
    con = duckdb.connect()
    want = [con.sql(f"SELECT round(v, 0), round(v, 2), round(v, 6) FROM (SELECT {'NULL' if v is None else v}::DOUBLE AS v)").fetchall()[0] for v in values]
    assert [tuple(r) for r in got] == want and got[1150][1] == 0.57


def test_threshold_sweep_has_the_cells_of_its_sql(spark, tmp_path):
    spark.createDataFrame([(i, 1100 + 10 * i) for i in range(20)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con, (run, sql) = duckdb.connect(), ANALYTICS["q_threshold_sweep"]
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, want = run(spark, str(tmp_path)), con.sql(sql)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_suppress_counts_in_order_and_takes_many_boxes(spark):
    r = random.Random(2)
    rows = [(1, i, [r.random() * 60, r.random() * 60, 10.0 + r.random(), 10.0], r.randrange(9) / 9, 0.5) for i in range(700)]
    kept = []
    for _, i, box, _, _ in sorted(rows, key=lambda x: (-x[3], -x[4], x[1])):
        hit = next((k for k in kept if sequences.box_iou(k[1], box) >= 0.6), None)
        if hit:
            hit[2] += 1
        else:
            kept.append([i, box, 0])
    schema = "media_id long, id long, bbox array<double>, quality double, detection double"
    found = sequences.suppress(spark.createDataFrame(rows, schema), "media_id").collect()
    assert {(x.id, x.covered) for x in found} == {(i, n) for i, _, n in kept} and 256 < len(kept) < 700
    # 8,000 boxes apart: one by one that were 32 million comparisons in Python
    apart = spark.range(8000).selectExpr("2L AS media_id", "id", "array(id * 30.0D, 0.0D, 20.0D, 20.0D) AS bbox", "0.5D AS quality", "0.5D AS detection")
    start = time.perf_counter()
    assert sequences.suppress(apart, "media_id").count() == 8000 and time.perf_counter() - start < 60


def test_the_nearest_are_selected_as_a_stable_sort_has_them():
    g = np.random.default_rng(0)
    for k in (1, 3, 7, 40):
        sim = g.integers(0, 4, size=(25, 40)).astype(float)  # many ties
        sim[g.random(sim.shape) < 0.2] = -np.inf
        want = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        i, j = vectors._top(sim, k)
        assert i.tolist() == np.repeat(np.arange(25), k).tolist() and j.tolist() == want.ravel().tolist()
    assert [len(x) for x in vectors._top(np.zeros((3, 0)), 2)] == [0, 0]
