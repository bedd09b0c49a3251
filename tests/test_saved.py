import random
from datetime import datetime, timedelta

from galleon.plans import saved as op
from galleon.plans.search import HybridQuery

MEDIA = "id long, kind string, captured_at timestamp_ntz, deleted_at string, missing int"
FACES = "media_id long, person_id long, deleted_at string, review_state string, quality double"
WORDS = ["beach", "sunset", "party", "snow", "dog", "at"]


def library(seed, n=150):
    r = random.Random(seed)
    media = [(i, r.choice(["photo", "photo", "video"]), None if r.random() < 0.1 else datetime(2020, 1, 1) + timedelta(days=r.randint(0, 900), hours=r.randint(0, 23)), "x" if r.random() < 0.05 else None, int(r.random() < 0.05)) for i in range(n)]
    faces = [(r.randrange(n), r.randint(1, 6), "x" if r.random() < 0.1 else None, r.choice(["unreviewed", "confirmed", "rejected"]), r.choice([None, 0.2, 0.5, 0.9])) for _ in range(2 * n)]
    captions = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 4))) if r.random() < 0.9 else None) for i in range(n)]
    return media, faces, captions


def queries(seed, n=60):
    r = random.Random(seed)
    some = lambda xs, k: tuple(r.sample(xs, r.choice(k)))
    out = [HybridQuery(), HybridQuery(kind="video"), HybridQuery(people=(99,)), HybridQuery(text="at")]
    for _ in range(n):
        a = datetime(2020, 1, 1) + timedelta(days=r.randint(0, 900))
        b = a + timedelta(days=r.choice([0, 3, 40, 400, 1200]))
        dates = r.choice([(None, None), (a, None), (None, b), (a, b)])
        low, high = (d.date().isoformat() if d else None for d in dates)
        out.append(HybridQuery(text=" ".join(some(WORDS, [0, 0, 1, 2])), people=some(range(1, 7), [0, 0, 1, 2]), exclude=some(range(1, 7), [0, 0, 1]), mode=r.choice(["AND", "OR"]), kind=r.choice([None, "photo", "video"]), date_from=low, date_to=high, min_quality=r.choice([None, None, 0.4])))
    return out


def test_reverse_matches_are_those_of_every_search(spark):
    media, faces, captions = (spark.createDataFrame(rows, s) for rows, s in zip(library(0), (MEDIA, FACES, "id long, caption string"), strict=True))
    asked = queries(1, 16)
    saved = op.save(spark, [(i, f"s{i}", q) for i, q in enumerate(asked)])
    got = {}
    for r in op.matches(saved, media, faces, captions).collect():
        got.setdefault(r.search_id, []).append(r.id)
    want = {i: sorted(r.id for r in op.run(saved, i, media, faces, captions).collect()) for i in range(len(asked))}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x} and len(got) > 8


def plain(q, item, people, quality, words):
    _, kind, at, deleted, missing = item
    day = at.date().isoformat() if at else None
    asked = {w for w in q.text.split() if len(w) > 2}
    return (
        deleted is None and not missing and (q.kind is None or kind == q.kind)
        and (q.date_from is None or (day is not None and day >= q.date_from)) and (q.date_to is None or (day is not None and day <= q.date_to))
        and (not q.people or (bool(people & set(q.people)) if q.mode == "OR" else set(q.people) <= people))
        and not people & set(q.exclude) and (q.min_quality is None or any(x is not None and x >= q.min_quality for x in quality)) and (not asked or bool(asked & words))
    )


def test_reverse_matches_against_brute_force(spark):
    media, faces, captions = library(3)
    asked = queries(4)
    want = set()
    for item in media:
        mine = [f for f in faces if f[0] == item[0] and f[2] is None]
        words = set((dict(captions)[item[0]] or "").split())
        want |= {(i, item[0]) for i, q in enumerate(asked) if plain(q, item, {f[1] for f in mine if f[3] != "rejected"}, [f[4] for f in mine], words)}
    frames = (spark.createDataFrame(rows, s) for rows, s in zip((media, faces, captions), (MEDIA, FACES, "id long, caption string"), strict=True))
    got = [(r.search_id, r.id) for r in op.matches(op.save(spark, [(i, "s", q) for i, q in enumerate(asked)]), *frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_empty(spark):
    media, faces, captions = (spark.createDataFrame([], s) for s in (MEDIA, FACES, "id long, caption string"))
    saved = op.save(spark, [(1, "all", HybridQuery())])
    assert op.matches(saved, media, faces, captions).count() == 0
    assert op.load(saved, 1) == HybridQuery()
