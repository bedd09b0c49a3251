import itertools
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from galleon.operators import identity, learning
from galleon.plans import search as S

TODAY = date(2026, 9, 30)


@pytest.mark.parametrize("words,low,high,rest", [
    ("beach last summer", "2025-06-01", "2025-08-31", "beach"),
    ("photos from 2024", "2024-01-01", None, "photos"),
    ("in march 2025", "2025-03-01", "2025-03-31", ""),
    ("before june 2024 dogs", None, "2024-05-31", "dogs"),
    ("yesterday", "2026-09-29", "2026-09-29", ""),
    ("last week", "2026-09-21", "2026-09-27", ""),
    ("winter 2024", "2024-12-01", "2025-02-28", ""),
    ("december", "2025-12-01", "2025-12-31", ""),
    ("since 2020 until 2022", "2020-01-01", "2021-12-31", ""),
    ("nothing here", None, None, "nothing here"),
])
def test_date_phrases(words, low, high, rest):
    assert S.parse_dates(words, TODAY) == (low, high, rest)


def library(spark):
    t = datetime(2025, 1, 1)
    media = spark.createDataFrame([(i, "video" if i % 5 == 0 else "photo", t + timedelta(days=i), "d" if i == 7 else None, 1 if i == 8 else 0) for i in range(1, 121)], "id long, kind string, captured_at timestamp_ntz, deleted_at string, missing int")
    links = [(i, 1) for i in range(1, 41)] + [(i, 2) for i in range(30, 61)]
    faces = spark.createDataFrame([(m, p, None, "ok", m / 120) for m, p in links], "media_id long, person_id long, deleted_at string, review_state string, quality double")
    r = np.random.default_rng(0)
    vecs = {i: r.normal(size=8) for i in range(1, 121)}
    emb = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vecs.items()], "id long, embedding array<double>")
    rr = random.Random(0)
    caps = {i: " ".join(rr.choices(["dog", "beach", "cake", "tree"], k=6)) for i in range(1, 121)}
    return media, faces, emb, spark.createDataFrame(list(caps.items()), "id long, caption string"), vecs, caps


def test_filters_against_sets(spark):
    media, faces, *_ = library(spark)
    ids = lambda **k: {r.id for r in S.filtered(S.HybridQuery(**k), media, faces).collect()}
    live = set(range(1, 121)) - {7, 8}
    assert ids(people=(1, 2), mode="OR") == live & set(range(1, 61))
    assert ids(people=(1, 2, 2)) == set(range(30, 41))
    assert ids(exclude=(2,)) == live - set(range(30, 61))
    assert ids(min_quality=0.4) == set(range(48, 61))
    assert ids(kind="video", date_from="2025-01-11", date_to="2025-01-21") == {10, 15, 20}


def test_fusion_against_ranks(spark):
    media, faces, emb, caps, vecs, text = library(spark)
    q = S.HybridQuery(text="dog beach", vector=tuple(map(float, vecs[3])), weights={"vector": 1.0, "text": 0.5, "recency": 0.2}, size=200)
    out = S.search(q, media, faces, emb, caps).collect()
    live = [i for i in range(1, 121) if i not in (7, 8)]
    cos = {i: float(vecs[i] @ vecs[3] / np.linalg.norm(vecs[i]) / np.linalg.norm(vecs[3])) for i in live}
    words = {i: text[i].split() for i in live}
    bm = {}
    for i in live:
        s = 0.0
        for t in ("dog", "beach"):
            df, tf = sum(t in w for w in words.values()), words[i].count(t)
            s += math.log(1 + (len(live) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)
        if s:
            bm[i] = s
    score = dict.fromkeys(live, 0.0)
    for w, signal in ((1.0, cos), (0.5, bm), (0.2, {i: i for i in live})):
        for k, i in enumerate(sorted(signal, key=lambda i: (-signal[i], -i))):
            score[i] += w / (61 + k)
    assert [r.id for r in out[:40]] == sorted(live, key=lambda i: (-round(score[i], 12), -i))[:40]
    pages = [[r.id for r in S.search(S.HybridQuery(text="dog", page=p, size=10), media, faces, emb, caps).collect()] for p in (1, 2)]
    assert pages[0] + pages[1] == [r.id for r in S.search(S.HybridQuery(text="dog", size=20), media, faces, emb, caps).collect()]


def test_words_to_query(spark):
    people = spark.createDataFrame([(1, "Alice"), (2, "Bob Stone")], "id long, name string")
    q = S.parse("photos of Alice or bob stone at the beach last summer", TODAY, people)
    assert (q.people, q.mode, q.kind, q.text, q.date_from) == ((2, 1), "OR", "photo", "beach", "2025-06-01")
    assert S.relaxed(q).text == ""


def test_assignment_needs_a_margin(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.71, 0.70, 0.0])], "face_id long, embedding array<double>")
    people = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "person_id long, centroid array<double>")
    assert {(r.face_id, r.person_id) for r in identity.assign(faces, people, 0.5).collect()} == {(1, 1), (2, None), (3, None)}


def test_suggestions_and_plan(spark):
    r = np.random.default_rng(2)
    base = {p: np.eye(16)[p] for p in (1, 2, 3)}
    base[4] = base[1]
    rows = [(p, p * 10 + k, [float(x) for x in base[p] + 0.05 * r.normal(size=16)], 0.5 + k / 10) for p, k in itertools.product(base, range(4))]
    crops = spark.createDataFrame(rows, "person_id long, face_id long, embedding array<double>, quality double")
    assert [(x.a, x.b) for x in identity.merge_suggestions(crops, 0.5, 0.7).collect()] == [(1, 4)]
    apart = spark.createDataFrame([(1, 4)], "a long, b long")
    assert identity.merge_suggestions(crops, 0.5, 0.7, apart).collect() == []
    assert identity.merge_plan([(1, 2), (2, 3), (4, 5), (6, 7)], {2, 4, 5}, 5) == [(1, 2), (7, 6)]


def test_learning_gates(spark):
    rows = [(i, 0.92 if i % 2 else 0.55, 0.8, 0.9, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "media_id long, similarity double, quality double, detection double, correct int")
    fit = learning.train(df)
    assert fit is not None and fit.coefficients[0] > 0
    assert learning.train(df.where("media_id < 30")) is None
    assert learning.tune(df.select("similarity", "correct"), 0.5, high=0.95) == 0.605
    assert learning.tune(df.limit(10), 0.5) == 0.5
