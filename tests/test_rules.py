"""Rules with an order of their own (events, tracks, dates), against plain Python."""

import math
import random
import time
from datetime import date, datetime, timedelta
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleon.functions import scalars as X
from galleon.operators import events, facets, sequences
from galleon.plans import search as S

ITEM = "user_id long, event_id long, ts timestamp_ntz, lat double, lon double, vec array<double>, people array<long>"


# --- events: one item after the other, everything computed anew each time


def far(a, b):
    (p, q), (r, s) = (map(math.radians, x) for x in (a, b))
    chord = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, chord)))


def hours(a, b):
    return (b - a).total_seconds() / 3600


def place(x):
    return None if x[1] is None or x[2] is None else (x[1], x[2])


def middle(items):
    known = [place(x) for x in items if place(x)]
    return (median(p[0] for p in known), median(p[1] for p in known)) if known else None


def same_run(a, b):
    gap = hours(a[0], b[0])
    if gap > 4:
        return False
    if place(a) and place(b):
        d = far(place(a), place(b))
        return d <= 150 and d / max(gap, 0.25) <= 300
    return True


def by_looks(items):
    looks = lambda part: [np.array(x[3]) for x in part if x[3] is not None]
    if len(looks(items)) >= 4:
        for k in range(2, len(items) - 1):
            x, y = looks(items[:k]), looks(items[k:])
            if hours(items[k - 1][0], items[k][0]) >= 1.5 and min(len(x), len(y)) >= 2:
                u, v = sum(x) / len(x), sum(y) / len(y)
                if u @ v / max(np.linalg.norm(u) * np.linalg.norm(v), 1e-9) < 0.45:
                    return by_looks(items[:k]) + by_looks(items[k:])
    return [items]


def one_event(old, new, home):
    gap, p, q = hours(old[-1][0], new[0][0]), middle(old), middle(new)
    away = lambda x: x is not None and home is not None and far(x, home) > 40
    if away(p) and away(q) and far(p, q) <= 400 and gap <= 36:
        return True
    if q is None and away(p) and gap <= 18:
        return True
    who = [{i for x in part for i in x[4] or ()} for part in (old, new)]
    alike = all(who) and len(who[0] & who[1]) / len(who[0] | who[1]) >= 0.5
    return alike and gap <= 12 and old[0][0].date() == new[0][0].date() and (p is None or q is None or far(p, q) <= 40)


def brute_events(items, home):
    runs = []
    for x in items:
        if runs and same_run(runs[-1][-1], x):
            runs[-1].append(x)
        else:
            runs.append([x])
    out = []
    for part in (p for r in runs for p in by_looks(r)):
        if out and one_event(out[-1], part, home):
            out[-1] = out[-1] + part
        else:
            out.append(part)
    return [[x[5] for x in e] for e in out]


def found_events(spark, rows):
    out = {}
    for r in events.detect(spark.createDataFrame(rows, ITEM)).collect():
        out.setdefault((r.user_id, r.super, r.event), []).append(r.event_id)
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize("seed", range(3))
def test_events_against_brute_force(spark, seed):
    r = random.Random(seed)
    home, rows, want = (48.0, 2.0), [], []
    spots = [home, home, home, (48.1, 2.1), (50.5, 4.0), (51.0, 4.4), (40.0, 20.0)]
    for user in range(12):
        t, spot, items = datetime(2024, 1, 1) + timedelta(hours=user), home, []
        for k in range(120):
            t += timedelta(hours=r.choice([0.1, 0.3, 1.0, 1.7, 1.8, 3.0, 5.0, 9.0, 17.0, 20.0, 40.0]), seconds=r.randint(0, 500))
            if r.random() < 0.3:
                spot = r.choice(spots)
            gps = r.random() < 0.75
            vec = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 0.0]][r.randint(0, 3)] if r.random() < 0.8 else None
            people = r.choice([None, [], [1], [1, 2], [3], [2, 3]])
            items.append((t, spot[0] + r.uniform(-0.01, 0.01) if gps else None, spot[1] + r.uniform(-0.01, 0.01) if gps else None, vec, people, user * 1000 + k))
        rows += [(user, i, t, a, o, v, p) for t, a, o, v, p, i in items]
        rows += []
        cells = {}
        for t, a, o, *_ in items:
            if a is not None:
                cells.setdefault((round(a * 20) / 20, round(o * 20) / 20), []).append(t)
        best = max(cells, key=lambda c: (len({(t.year, t.month) for t in cells[c]}), len({t.date() for t in cells[c]}), len(cells[c]), -c[0], -c[1]))
        want += brute_events(items, best)
    assert found_events(spark, rows) == sorted(sorted(e) for e in want)


def test_looks_and_people_decide(spark):
    t0, a, b = datetime(2024, 4, 1, 9), [1.0, 0.0], [0.0, 1.0]
    sizes = lambda rows: sorted(map(len, found_events(spark, rows)))
    row = lambda i, minutes, v=None, p=None, gps=True: (1, i, t0 + timedelta(minutes=minutes), 23.8 if gps else None, 90.4 if gps else None, v, p)
    assert sizes([row(i, 20 * i, a if i < 5 else b) for i in range(10)]) == [10]
    assert sizes([row(i, 20 * i + 100 * (i >= 5), a if i < 5 else b) for i in range(10)]) == [5, 5]
    assert sizes([row(i, 20 * i + 100 * (i >= 5), a) for i in range(10)]) == [10]
    assert sizes([row(0, 0, a), row(1, 5, a), row(2, 105, b), row(3, 110, b)]) == [2, 2]  # two a side are enough
    assert sizes([row(1, 0, None, [7, 8], False), row(2, 300, None, [7, 8], False)]) == [2]
    assert sizes([row(1, 0, None, [7], False), row(2, 300, None, [9], False)]) == [1, 1]


def test_trips_and_days_at_home(spark):
    home, cox, paris, sylhet = (23.8103, 90.4125), (21.4272, 92.0058), (48.8566, 2.3522), (24.8949, 91.8687)
    rows = []

    def day(d, at, hours=range(9, 21, 2), none_every=0):
        for n, h in enumerate(hours):
            gps = not (none_every and n % none_every == 0)
            lat, lon = (at[0] + 0.01 * math.sin(n), at[1] + 0.01 * math.cos(n)) if gps else (None, None)
            rows.append((1, len(rows), datetime.fromisoformat(d) + timedelta(hours=h, minutes=7 * n), lat, lon, None, None))

    day("2024-01-05", home)
    for d, n in (("10", 0), ("11", 3), ("12", 0)):
        day(f"2024-02-{d}", cox, none_every=n)
    day("2024-03-01", home, range(10, 16))
    for d in range(1, 6):
        day(f"2024-05-0{d}", paris)
    day("2024-07-10", sylhet)
    day("2024-07-11", sylhet)
    assert [len(e) for e in sorted(found_events(spark, rows))] == [6, 18, 6, 30, 12]


# --- tracks


def look(person, salt, noise=0.4):
    v = np.random.default_rng(person).standard_normal(512) + noise * np.random.default_rng(10_000 + salt).standard_normal(512)
    return v / np.linalg.norm(v)


def frames(tracks, *seen):
    """Tracks of frames (time, [(box, look, quality)])."""
    return [tracks.frame(t, np.array([b for b, _, _ in d], float), np.array([v for _, v, _ in d]), np.array([q for *_, q in d])).tolist() for t, d in seen]


def test_faces_that_cross_keep_their_tracks():
    seen = [(3.0 * k, [([20 + 40 * k, 50, 60, 60], look(1, k), 0.8), ([340 - 40 * k, 50, 60, 60], look(2, 100 + k), 0.8)]) for k in range(8)]
    assert frames(sequences.Tracks(), *seen) == [[1, 2]] * 8


def test_weak_faces_extend_tracks_and_gaps_end_them():
    box = [14, 12, 50, 50]
    out = frames(sequences.Tracks(), (0.0, [(box, look(1, 0), 0.8)]), (4.0, [(box, look(1, 1), 0.3)]), (20.0, [(box, look(1, 2), 0.8)]), (21.0, [(box, look(9, 3), 0.2)]))
    assert out == [[1], [1], [2], [3]]


def test_looks_beat_places():
    out = frames(sequences.Tracks(), (0.0, [([10, 10, 60, 60], look(1, 0), 0.8)]), (3.0, [([500, 300, 60, 60], look(1, 1), 0.8)]), (6.0, [([500, 300, 60, 60], look(7, 2), 0.8)]))
    assert out == [[1], [1], [2]]


def brute_tracks(rows):
    """(id -> track) by trying every matching of each stage."""
    import itertools

    def cover(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w / (a[2] * a[3] + b[2] * b[3] - w)

    def best(tracks, dets, gate):
        cost = {}
        for i, t in enumerate(tracks):
            for j, d in enumerate(dets):
                o, c = cover(t["box"], d[2]), float(t["look"] @ d[3])
                if c >= gate and (o >= 0.1 or c >= 0.55):
                    cost[i, j] = 1 - 0.4 * o - 0.6 * c
        top = (0, 0.0, [])
        k = min(len(tracks), len(dets))
        for cols in itertools.permutations(range(len(dets)), k):
            for some in itertools.combinations(range(len(tracks)), k):
                pairs = [(i, j) for i, j in zip(some, cols) if (i, j) in cost]
                top = max(top, (len(pairs), -sum(cost[p] for p in pairs), pairs), key=lambda x: x[:2])
        return top[2]

    out, tracks, made = {}, [], 0
    for ts in sorted({r[1] for r in rows}):
        dets = sorted(r for r in rows if r[1] == ts)
        tracks = [t for t in tracks if ts - t["ts"] <= 6]
        free = list(tracks)
        for sure, gate in ((True, 0.25), (False, 0.6)):
            some = [d for d in dets if (d[4] >= 0.45) == sure]
            hit = best(free, some, gate)
            for i, j in hit:
                t, d = free[i], some[j]
                v = 0.8 * t["look"] + 0.2 * d[3]
                t.update(box=d[2], ts=ts, look=v / np.linalg.norm(v))
                out[d[0]] = t["id"]
            free = [t for i, t in enumerate(free) if i not in {i for i, _ in hit}]
        for sure in (True, False):
            for d in dets:
                if d[0] not in out and (d[4] >= 0.45) == sure:
                    made += 1
                    out[d[0]] = made
                    tracks.append({"id": made, "box": d[2], "look": d[3], "ts": ts})
    return out


def test_tracks_against_every_matching(spark):
    r = random.Random(5)
    rows, people = [], [np.random.default_rng(p).standard_normal(6) for p in range(4)]
    for k in range(25):
        for p in r.sample(range(4), r.randint(1, 3)):
            v = people[p] + 0.5 * np.random.default_rng(len(rows)).standard_normal(6)
            rows.append((len(rows), k * r.choice([2.0, 2.5]), [40.0 * p + r.uniform(-20, 20), r.uniform(0, 20), 40.0, 40.0], v / np.linalg.norm(v), r.choice([0.2, 0.5, 0.9])))
    df = spark.createDataFrame([(1, i, t, b, v.tolist(), None, q) for i, t, b, v, q in rows], "media_id long, id long, ts double, bbox array<double>, vec array<double>, quality double, detection double")
    tracks = sequences.track(df)
    want = brute_tracks(rows)
    assert {x.id: x.track for x in tracks.collect()} == want
    about = {x.track: (x.first_ts, x.last_ts, x.hits) for x in sequences.track_summary(df, tracks).collect()}
    assert about == {t: (min(ts), max(ts), len(ts)) for t in set(want.values()) for ts in [[r[1] for r in rows if want[r[0]] == t]]}


def test_diversity_against_one_pick_at_a_time(spark):
    r = np.random.default_rng(3)
    rows = [(i, i, None if i % 7 == 0 else float(r.uniform()), None if i % 3 == 0 else r.normal(size=4).tolist(), f"d{i % 5}") for i in range(60)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, _, v, _ in rows if v}
    picked = []
    while len(picked) < 20:
        def gain(row):
            i, _, score, v, day = row
            near = max((unit[i] @ unit[j[0]] for j in picked if j[3]), default=0.0) if v else min(1, sum(j[4] == day for j in picked) / 4)
            return 0.7 * (0.6 * (1 - i / 60) + 0.4 * (0.5 if score is None else score)) - 0.3 * near

        picked.append(max((x for x in rows if x not in picked), key=gain))
    df = spark.createDataFrame(rows, "id long, rank long, score double, vec array<double>, day string")
    assert [x.id for x in sequences.diverse(df, 20).orderBy("place").collect()] == [x[0] for x in picked]


# --- dates

TODAY = date(2026, 9, 30)


@pytest.mark.parametrize("words,low,high,rest", [
    ("2019", "2019-01-01", "2019-12-31", ""),
    ("since 2018", "2018-01-01", None, ""),
    ("before 2018", None, "2017-12-31", ""),
    ("last year", "2025-01-01", "2025-12-31", ""),
    ("this month", "2026-09-01", "2026-09-30", ""),
    ("winter", "2025-12-01", "2026-02-28", ""),
    ("autumn", "2026-09-01", "2026-11-30", ""),
    ("this winter", "2026-12-01", "2027-02-28", ""),
    ("last winter", "2025-12-01", "2026-02-28", ""),
    ("dec 2024", "2024-12-01", "2024-12-31", ""),
    ("cake, Dec. 2024", "2024-12-01", "2024-12-31", "cake"),
    ("sep", "2026-09-01", "2026-09-30", ""),
    ("oct dogs", "2025-10-01", "2025-10-31", "dogs"),
    ("feb 2024", "2024-02-01", "2024-02-29", ""),
    ("img 20190101", None, None, "img 20190101"),
])
def test_date_phrases(words, low, high, rest):
    assert S.parse_dates(words, TODAY) == (low, high, rest)


NAMES = [
    ("IMG_20190918_164153.jpg", "2019-09-18 16:41:53"),
    ("PXL_20230425_125050434.jpg", "2023-04-25 12:50:50"),
    ("2021-06-01 12.30.00.jpg", "2021-06-01 12:30:00"),
    ("IMG-20200101-WA0001.jpg", "2020-01-01 12:00:00"),
    ("Screenshot_2020-02-03-10-11-12.png", "2020-02-03 10:11:12"),
    ("VID_20221231_235959.mp4", "2022-12-31 23:59:59"),
    ("holiday.jpg", None),
    ("IMG_1234.jpg", None),
    ("20991231_000000.jpg", None),
    ("a/20200101/b.jpg", None),
    ("x 2020-02-30 and 2020-03-01.jpg", "2020-03-01 12:00:00"),
    ("19800101.jpg", None),
    ("19800101 20010203.jpg", "2001-02-03 12:00:00"),
    ("2021_06_01T10h20m30.jpg", "2021-06-01 10:20:30"),
    ("20200101123.jpg", None),
    ("20200101_2512.jpg", "2020-01-01 12:00:00"),
    ("120200101.jpg", None),
    ("20200101103059.jpg", "2020-01-01 10:30:59"),
    ("20200101103059123.jpg", "2020-01-01 10:30:59"),
    (None, None),
    ("", None),
]


def test_dates_in_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i int, name string")
    found = df.select("i", F.date_format(X.date_in_name(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("i").collect()
    assert [(NAMES[r.i][0], r.t) for r in found] == NAMES


def test_camera_dates(spark):
    rows = [("2021:06:01 14:30:05", "2021-06-01 14:30:05"), ("2021-06-01 14:30:05+02:00", "2021-06-01 14:30:05"), ("2021:06:01", "2021-06-01 00:00:00"), ("0000:00:00 00:00:00", None), ("1970:01:01 00:00:00", None), ("", None), (None, None), ("2021:13:01 00:00:00", None), ("junk", None), ("2999:01:01 00:00:00", None)]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(rows)], "i int, name string")
    found = df.select("i", F.date_format(X.exif_date(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("i").collect()
    assert [(rows[r.i][0], r.t) for r in found] == rows


def test_people_in_words(spark):
    people = spark.createDataFrame([(1, "Alice", 3), (2, "Bob Stone", 2), (3, "Bobby", 1), (4, "Nobody", 0), (5, "Ann Lee", 1)], "id long, name string, face_count long")
    who = lambda words: S.match_people(words, people)
    assert who("alice at beach") == ((1,), "at beach")
    assert who("bob stone and Alice") == ((2, 1), "and")
    assert who("stone lee") == ((2, 5), "")  # parts of one name each
    assert who("bob") == ((), "bob")  # in two names
    assert who("nobody an") == ((), "nobody an")


# --- boxes, sections, evaluation


def test_suppression_against_brute_force(spark):
    r = random.Random(2)
    rows = [(m, 100 * m + k, [r.uniform(0, 60), r.uniform(0, 60), 30.0, 30.0], round(r.random(), 1), r.random()) for m in (1, 2) for k in range(40)]
    want = []
    for m in (1, 2):
        kept = []
        for _, i, b, q, d in sorted((x for x in rows if x[0] == m), key=lambda x: (-x[3], -x[4], x[1])):
            hit = next((k for k in kept if sequences.box_iou(k[1], b) >= 0.6), None)
            if hit:
                hit[2] += 1
            else:
                kept.append([i, b, 0])
        want += [(m, i, n) for i, _, n in kept]
    df = spark.createDataFrame(rows, "media_id long, id long, bbox array<double>, quality double, detection double")
    assert sorted(map(tuple, sequences.suppress(df, "media_id").collect())) == sorted(want)
    assert abs(sequences.box_iou([0, 0, 10, 10], [5, 0, 10, 10]) - 1 / 3) < 1e-12 and sequences.box_iou([0, 0, 0, 0], [0, 0, 0, 0]) == 0


def test_sections_against_a_fold(spark):
    r = random.Random(3)
    rows = sorted({f"2024-{m:02d}-{r.randint(1, 28):02d}" for m in range(1, 9) for _ in range(12)})
    rows = [(d, r.choice([1, 2, 5, 7, 8, 20])) for d in rows]
    want = []
    for month in sorted({d[:7] for d, _ in rows}):
        open_ = []
        for d, n in sorted((x for x in rows if x[0][:7] == month), reverse=True):
            if open_ and open_[-1][2] < 8 and n < 8:
                last = open_[-1]
                open_[-1] = (d, last[1], last[2] + n, last[3] + 1)
            else:
                open_.append((d, d, n, 1))
        want += [(month, i + 1, *x) for i, x in enumerate(open_)]
    df = spark.createDataFrame(rows, "day string, n long")
    assert sorted(map(tuple, sequences.timeline_sections(df).collect())) == want


def test_leave_one_out_against_brute_force(spark):
    from galleon.operators import vectors

    v = np.random.default_rng(6).normal(size=(60, 5)).astype(np.float32)
    label = [i % 4 for i in range(60)]
    df = spark.createDataFrame([(i, label[i], x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<float>")
    v = v.astype(float)
    for row in vectors.leave_one_out(df, "label", 0.1).collect():
        i = row.vec_id
        to = {c: sum(v[j] for j in range(60) if label[j] == c and j != i) for c in range(4)}
        cos = {c: s @ v[i] / np.linalg.norm(s) for c, s in to.items()}
        own, wrong = cos[label[i]], max(x for c, x in cos.items() if c != label[i])
        assert abs(row.own - own) < 1e-5 and abs(row.wrong - wrong) < 1e-5
        assert row.outcome == ("tp" if own >= 0.1 and wrong < 0.1 else "fp" if wrong >= 0.1 else "fn")


def test_names_of_screenshots(spark):
    names = {"Screenshot_1.png": True, "my screen shot": True, "SCREEN-CAPTURE 2": True, "screen_recording": False, "Screen Recording 3": True, "capture1": True, "Capture_2": True, "capture--3": False, "capture": False, "a capture 3": False, "snippet": True, "a snip": False, "screen  shot": False, None: None}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", facets.named_as_screenshot(F.col("name")).alias("is")).collect()
    assert {r.name: r["is"] for r in rows} == names


def test_dates_in_names_have_small_plans(spark):
    df = spark.createDataFrame([("IMG_20240131_235959.jpg",)], "name string").select(X.date_in_name(F.col("name")).alias("at"))
    start = time.perf_counter()
    assert str(df.first()["at"]) == "2024-01-31 23:59:59"
    assert time.perf_counter() - start < 20 and len(df._jdf.queryExecution().analyzed().toString()) < 20_000
