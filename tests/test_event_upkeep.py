import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from galleon.operators import event_upkeep as op
from galleon.operators import events, library

SCHEMA = "user_id long, event_id long, ts timestamp, lat double, lon double, vec array<double>, people array<long>"


def item(r, i):
    at = datetime(2024, 1, 1) + timedelta(days=r.choice([0, 1, 2, 6, 7, 12, 13]) + r.random() * r.choice([0.1, 1.5]))
    place = r.choice([(48.0, 2.0), (48.0, 2.0), (41.0, 12.0), (None, None)])
    lat, lon = (None, None) if place[0] is None else (place[0] + r.random() / 50, place[1])
    vec = r.choice([[1.0, 0.0], [0.0, 1.0], [0.7, 0.7], None])
    return (r.randint(1, 3), i, at, lat, lon, vec, r.choice([[], [1], [1, 2], [3]]))


def parts(rows, by):
    found = {}
    for k, g in rows:
        found.setdefault(g, set()).add(k)
    return {frozenset(x) for x in found.values()}


def test_every_batch_ends_as_a_full_run(spark):
    r, items, state, held = random.Random(1), {}, None, {}
    for batch in range(4):
        changed = []
        if batch:
            for i in r.sample(sorted(items), 5):
                old = items.pop(i)
                if r.random() < 0.5:  # a change; else it is gone
                    items[i] = (old[0], *item(r, i)[1:])
                    changed.append((old[0], i))
        for i in range(batch * 25, batch * 25 + r.choice([12, 25])):
            items[i] = item(r, i)
        df = spark.createDataFrame(list(items.values()), SCHEMA)
        state = state or op.begin(df)
        state, touched = op.refresh(df, state, spark.createDataFrame(changed, "user_id long, event_id long"))
        now = {(x.user_id, x.event_id): x.event for x in state.items.collect()}
        want = events.detect(df).select("user_id", "event_id", F.struct("user_id", "super", "event").alias("g")).collect()
        assert parts(now.items(), 0) == parts([((x.user_id, x.event_id), x.g) for x in want], 0)
        assert max(now.values()) < state.next_id
        again = {(x.user_id, x.event_id) for x in touched.collect()}
        assert {k for k in now if held.get(k) != now[k]} <= again
        held = now
    state, touched = op.refresh(df, state)
    assert touched.count() == 0 and {(x.user_id, x.event_id): x.event for x in state.items.collect()} == held


def test_a_new_item_leaves_far_events_alone(spark):
    base = datetime(2024, 5, 1)
    rows = [(1, i, base + timedelta(days=5 * (i // 4), hours=i % 4), 48.0, 2.0, None, []) for i in range(40)]
    state, _ = op.refresh(spark.createDataFrame(rows, SCHEMA), op.begin(spark.createDataFrame(rows, SCHEMA)))
    more = [*rows, (1, 99, base + timedelta(hours=3.5), 48.0, 2.0, None, [])]
    after, touched = op.refresh(spark.createDataFrame(more, SCHEMA), state)
    assert {x.event_id for x in touched.collect()} == {0, 1, 2, 3, 99}
    assert {x.event for x in after.items.where("event_id in (0, 99)").collect()} == {x.event for x in state.items.where("event_id = 0").collect()}
    assert after.next_id == state.next_id
    locked = spark.createDataFrame([(1, 99)], "user_id long, event_id long")
    same, touched = op.refresh(spark.createDataFrame(more, SCHEMA), state, locked=locked)
    assert touched.count() == 0 and same.items.count() == 40


def greedy(votes):
    used, out = set(), {}
    for place in sorted({p for p, _, _ in votes}):
        for _, e in sorted((-v, e) for p, e, v in votes if p == place):
            if e not in used:
                used.add(e)
                out[place] = e
                break
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_ids_as_groups_choose_one_after_the_other(spark, seed):
    r = random.Random(seed)
    votes = sorted({(r.randint(1, 40), r.randint(1, 30)) for _ in range(120)})
    votes = [(p, e, r.randint(1, 4)) for p, e in votes]
    got = {x.place: x.event_id for x in op.match_ids(spark.createDataFrame(votes, "place long, event_id long, votes long")).collect()}
    assert got == greedy(votes)


def test_new_ids_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k long, v string")
    want = {i: i + 5 for i in range(101)}
    for n in (1, 7):
        assert {x.k: x.id for x in op.dense_ids(rows.repartition(n), ["k"], 5, "id").collect()} == want


def test_stable_ids_against_the_rule(spark):
    r = random.Random(4)
    found = [(i % 3, r.randint(1, 6), i) for i in range(150)]
    current = [(i, r.randint(1, 25), int(r.random() < 0.1)) for i in range(150)]
    edited = {3, 9}
    free = {m: e for m, e, locked in current if not locked and e not in edited}
    votes = {}
    for s, g, m in found:
        if m in free:
            votes[(s, g), free[m]] = votes.get(((s, g), free[m]), 0) + 1
    want = greedy([(p, e, v) for (p, e), v in votes.items()])
    top = 25
    for place in sorted({(s, g) for s, g, _ in found} - set(want)):
        want[place] = top = top + 1
    ev = spark.createDataFrame([(e, int(e in edited)) for e in range(1, 26)], "id long, user_edited int")
    out = library.stable_ids(spark.createDataFrame(found, "scope long, group long, media_id long"), spark.createDataFrame(current, "media_id long, event_id long, locked int"), ev)
    assert {(x.scope, x.group): x.event_id for x in out.collect()} == want


def test_old_sessions_are_told_only_where_items_are_gone(spark, monkeypatch):
    """A batch that only adds items cuts sessions twice (all, and those clustered anew), one that removes some, three times."""
    calls, plain = [], op.sessions.sessions
    monkeypatch.setattr(op.sessions, "sessions", lambda *a, **k: calls.append(1) or plain(*a, **k))
    r = random.Random(3)
    rows = [item(r, i) for i in range(30)]
    df = lambda some: spark.createDataFrame(some, SCHEMA)
    state, _ = op.refresh(df(rows[:20]), op.begin(df(rows)))
    assert len(calls) == 2
    state, _ = op.refresh(df(rows), state)
    assert len(calls) == 4
    op.refresh(df(rows[5:]), state)
    assert len(calls) == 7


def test_every_row_knows_the_first_of_its_event(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([item(r, i) for i in range(60)], SCHEMA).withColumn("old", F.col("event_id") * 2)
    found = [x.asDict() for x in events.numbered(rows, 60, "user_id", "event_id", 10).collect()]
    first = {}
    for x in sorted(found, key=lambda x: (x["s"], x["event_id"])):
        assert first.setdefault((x["user_id"], x["super"], x["event"]), (x["s"], x["event_id"])) == (x["first_s"], x["first_key"])
        assert x["old"] == 2 * x["event_id"]
    assert len(found) == 60 and len(first) > 5
