import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from galleon.operators import sequences
from galleon.streaming import tracks

SCHEMA = "media_id long, id long, ts double, bbox array<double>, vec array<double>, detection double, quality double"
END = (-1, -1, 10_000.0, [0.0, 0.0, 1.0, 1.0], [1.0, 0.0, 0.0], 1.0, 1.0)  # moves the watermark past every video


def detections(seed=0, videos=4, frames=16):
    r, out = random.Random(seed), []
    for v in range(videos):
        people = [(r.uniform(0, 100), r.uniform(-4, 4), [r.gauss(0, 1) for _ in range(3)]) for _ in range(4)]
        for f in range(frames):
            for x, dx, look in people:
                if r.random() < 0.7:
                    box = [x + dx * f, 10.0 + r.random(), 20.0, 20.0]
                    out.append((v, len(out), f * 1.5 + (9 if f > 10 else 0), box, [a + r.gauss(0, 0.2) for a in look], r.choice([0.3, 0.6, 0.9]), r.choice([None, 0.2, 0.9])))
    return out


def run(spark, folder, rounds):
    """Each round's files come in a run of their own, on one checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracks.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, rows in enumerate(rounds):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            q = tracks.track_stream(stream, late="1 second").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return {(r.media_id, r.id): r.track for r in spark.read.parquet(f"{folder}/out").where("media_id >= 0").collect()}


@pytest.mark.parametrize("cuts", [1, 3])
def test_any_cut_gives_the_tracks_of_the_whole(spark, tmp_path, cuts):
    rows = detections(cuts)
    want = {(r.media_id, r.id): r.track for r in sequences.track(spark.createDataFrame(rows, SCHEMA)).collect()}
    rows.sort(key=lambda x: (x[2], x[0]))
    step = -(-len(rows) // cuts)  # cuts fall within frames
    rounds = [rows[i : i + step] for i in range(0, len(rows), step)]
    assert run(spark, tmp_path, [*rounds, [END]]) == want and max(want.values()) > 4


class _State:
    """A list or a value, as a state store has it."""

    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows) if self.many else self.rows[0]

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def update(self, row):
        self.rows = [row]


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def _make(self, name, many):
        self.states[name] = _State()
        self.states[name].many = many
        return self.states[name]

    def getListState(self, name, schema):
        return self._make(name, True)

    def getValueState(self, name, schema):
        return self._make(name, False)

    def registerTimer(self, at):
        self.timers.append(at)


class _Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return int((self.at + tracks.SHIFT) * 1000)


def test_a_batch_waits_as_one_row():
    """State grows with batches, not with a row for every detection; what is behind the watermark waits on."""
    rows = detections(2, videos=1, frames=40)
    pdf = pd.DataFrame({"id": [r[1] for r in rows], "ts": [r[2] for r in rows], "bbox": [r[3] for r in rows], "vec": [r[4] for r in rows], "q": [r[6] or r[5] for r in rows]})
    pdf["at"] = pd.to_datetime(((pdf["ts"] + tracks.SHIFT) * 1000).astype("int64"), unit="ms", utc=True)
    tracker, handle = tracks.Tracker("media_id", 6.0), _Handle()
    tracker.init(handle)
    cuts = np.array_split(np.arange(len(pdf)), 3)
    assert list(tracker.handleInputRows((0,), iter([pdf.iloc[c] for c in cuts]), None)) == []
    assert len(handle.states["waiting"].rows) == len(handle.timers) == 3
    early = pd.concat(tracker.handleExpiredTimer((0,), _Clock(20.0), None))
    assert len(handle.states["waiting"].rows) == 1 and len(handle.states["open"].rows) == 1
    late = pd.concat(tracker.handleExpiredTimer((0,), _Clock(1000.0), None))
    assert not handle.states["waiting"].rows and not handle.states["open"].rows
    whole = sequences.Tracks(6.0)
    want, pdf = {}, pdf.sort_values(["ts", "id"])
    for ts, f in pdf.groupby("ts"):
        looks = np.array(f["vec"].tolist())
        want |= dict(zip(f["id"], whole.frame(ts, np.array(f["bbox"].tolist()), looks / np.linalg.norm(looks, axis=1, keepdims=True), f["q"].to_numpy()), strict=True))
    got = pd.concat([early, late])
    assert 0 < len(early) < len(got) and dict(zip(got["id"], got["track"], strict=True)) == want


def test_equal_ids_take_their_turn_by_their_values(spark, tmp_path):
    """Detections of one id and time are told apart by their values, not by the order in which they came."""
    rows = [(*r[:1], r[1] // 3, *r[2:]) for r in detections(7)]
    want = [sorted(map(tuple, sequences.track(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, rows[::-1])]
    assert want[0] == want[1] and len({r[:2] for r in want[0]}) < len(rows)
    run(spark, tmp_path, [rows[::2], rows[1::2], [END]])
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("media_id >= 0").collect()) == want[0]


def test_what_is_behind_the_frames_taken_is_dropped():
    tracker, handle = tracks.Tracker("media_id", 6.0), _Handle()
    tracker.init(handle)
    row = lambda i, ts: pd.DataFrame({"id": [i], "ts": [ts], "bbox": [[0.0, 0.0, 9.0, 9.0]], "vec": [[1.0, 0.0]], "q": [0.9], "at": pd.to_datetime([(ts + tracks.SHIFT) * 1e9], utc=True)})
    for frame, now, want in [(row(1, 5.0), 6.0, [1]), (row(2, 5.5), 7.0, []), (row(3, 6.5), 8.0, [3])]:
        list(tracker.handleInputRows((0,), iter([frame]), None))
        assert [i for found in tracker.handleExpiredTimer((0,), _Clock(now), None) for i in found["id"]] == want


def test_detections_are_packed_by_video():
    """A keyed state gets a row for each video of an Arrow batch, as it takes its rows one by one."""
    n = 1000
    batch = pa.RecordBatch.from_pydict({"media_id": [None if i % 5 == 4 else i % 5 for i in range(n)], "id": range(n), "ts": [float(i % 7) for i in range(n)], "bbox": [[float(i), 0.0, 1.0, 1.0] for i in range(n)], "vec": [[1.0, float(i)] for i in range(n)], "q": [None if i == 3 else 0.5 for i in range(n)], "at": range(n)})
    out = pa.Table.from_batches(tracks._packer("media_id")(iter([batch, batch[:0]]))).to_pylist()
    assert sorted((r["media_id"] is None, r["media_id"], r["at"]) for r in out) == [(False, 0, 995), (False, 1, 996), (False, 2, 997), (False, 3, 998), (True, None, 999)]
    for r in out:
        ids, rows = tracks._unpack((r["ids"], r["rows"]))
        assert len(ids) == 200 and (rows[:, 0] == ids % 7).all() and (rows[:, 2] == ids).all() and (rows[:, 7] == ids).all() and np.isnan(rows[:, 1]).sum() == (3 in ids)


def test_few_and_many_price_alike():
    """Plain numbers and arrays give the same matching and the same tracks, ties, empty and undefined boxes included."""
    r = np.random.default_rng(5)
    for k in range(60):
        n, m = r.integers(1, 9, 2)
        cost = r.integers(0, 3, (n, m)).astype(float) if k % 2 else np.where(r.random((n, m)) < 0.6, sequences.NO_MATCH, r.random((n, m)))
        few, sequences.FEW = sequences.assign(cost), 0
        assert few == [(int(i), int(j)) for i, j in sequences.assign(cost)]
        sequences.FEW = 64
    ts = np.repeat(np.arange(60.0), 5)
    boxes, looks, q = r.integers(0, 30, (300, 4)).astype(float), r.normal(size=(6, 3))[r.integers(6, size=300)], r.random(300)
    boxes[::17, r.integers(4)], boxes[::13, 2], boxes[5, 0] = np.nan, 0.0, np.inf
    looks /= np.linalg.norm(looks, axis=1, keepdims=True)
    few, sequences.FEW = sequences.Tracks().frames(ts, boxes, looks, q), 0
    many = sequences.Tracks().frames(ts, boxes, looks, q)
    sequences.FEW = 64
    assert few.tolist() == many.tolist() and 5 < few.max() < 300
