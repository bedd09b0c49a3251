"""Tracking as a stream: detections arrive in micro-batches, tracks live in keyed state.

A video's detections wait in list state until the watermark has passed the last of their batch; a
timer then takes all that are complete in order, frame by frame, so the tracks do not depend on how
the stream was cut into batches, nor on restarts.  Open tracks are list state too.  A timer behind the last frame ends
them once no detection could join any more, so a finished video keeps one counter.

Detections are packed where they are read, those of a video in one Arrow batch as one row, as Spark hands a keyed state its rows
one by one.  A packed row is as late as its last detection; what is behind the frames already taken is dropped.

State schema: ``waiting`` (ids, rows: time, quality, box and look) has a row for every batch of a video's detections, as
packed arrays and not detection by detection; ``open`` (tracks, rows: last time, box and look) is one value, ``made`` has the number of tracks
and the time up to which frames are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import TRACK_GAP, Tracks, in_turn

WAITING = "ids binary, rows binary"
OPEN = "tracks binary, rows binary"
SHIFT = 86_400.0  # rows at the very start of time would count as late
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _pack(ids: np.ndarray | list[int], rows: np.ndarray) -> tuple[bytes, bytes]:
    return np.ascontiguousarray(ids, np.int64).tobytes(), np.ascontiguousarray(rows, float).tobytes()


def _unpack(packed: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(packed[0], np.int64)
    return ids, np.frombuffer(packed[1], float).reshape(len(ids), -1)


def _load(packed: tuple[bytes, bytes] | None, made: int, gap: float) -> Tracks:
    tracks = Tracks(gap)
    tracks.made = made
    if packed:
        ids, rows = _unpack(packed)
        tracks.ids, tracks.seen, tracks.boxes, tracks.looks = ids.tolist(), rows[:, 0].tolist(), rows[:, 1:5].tolist(), rows[:, 5:].copy()
    return tracks


def _packer(by: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row (by, last time in microseconds, ids, rows) for each video of an Arrow batch of detections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, at, ids = b.column(by).dictionary_encode("encode"), b.column("at").to_numpy(), b.column("id").to_numpy()
            group = keys.indices.to_numpy()
            lists = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("bbox", "vec"))
            rows = np.column_stack([b.column("ts").to_numpy(), b.column("q").to_numpy(zero_copy_only=False), *lists])
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            ids, rows, ends = ids[order], rows[order], [*starts[1:].tolist(), len(order)]
            packed = [_pack(ids[i:j], rows[i:j]) for i, j in zip(starts.tolist(), ends, strict=True)]
            last = np.maximum.reduceat(at[order], starts)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(group[order[starts]])), pa.array(last), *(pa.array(x, pa.binary()) for x in zip(*packed, strict=True))], [by, "at", "ids", "rows"])

    return run


class Tracker(StatefulProcessor):
    """Gives every detection its track, as ``sequences.track`` does over the whole video."""

    def __init__(self, by: str, gap: float):
        self.by, self.gap = by, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)
        self.made = handle.getValueState("made", "made long, done double")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            if "rows" in pdf:  # packed
                packed = b"".join(pdf["ids"]), b"".join(pdf["rows"])
            else:
                boxes, looks = (np.array(pdf[c].tolist(), float) for c in ("bbox", "vec"))
                packed = _pack(pdf["id"].to_numpy(), np.column_stack([pdf["ts"], pdf["q"], boxes, looks]))
            self.waiting.appendValue(packed)
            self.handle.registerTimer(int(pdf["at"].dt.tz_localize(None).astype("datetime64[ms]").astype("int64").max()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Takes all frames up to the watermark; frames behind it wait for later timers."""
        now = timerValues.getCurrentWatermarkInMs() / 1000 - SHIFT
        waiting = [_unpack(tuple(r)) for r in self.waiting.get()]
        made, done = self.made.get() if self.made.exists() else (0, -np.inf)
        tracks = _load(tuple(self.open.get()) if self.open.exists() else None, made, self.gap)
        ids = np.zeros(0, np.int64)
        if waiting:
            ids, rows = (np.concatenate(x) for x in zip(*waiting, strict=True))
            late = rows[:, 0] <= done + 1e-9
            due = (rows[:, 0] <= now + 1e-9) & ~late
            rest = (ids[~due & ~late], rows[~due & ~late])
            ids, rows = ids[due], rows[due]
        if waiting and len(rest[0]) < len(late):
            self.waiting.clear()
            if len(rest[0]):
                self.waiting.put([_pack(*rest)])
        if len(ids):
            order = in_turn(rows[:, 0], ids, rows[:, 1:])
            ids, rows = ids[order], rows[order]
            ts, quality, boxes, looks = rows[:, 0], rows[:, 1], rows[:, 2:6], rows[:, 6:]
            looks = looks / np.maximum(np.linalg.norm(looks, axis=1, keepdims=True), 1e-12)
            found = tracks.frames(ts, boxes, looks, quality)
            self.made.update((tracks.made, now))
            self.handle.registerTimer(int((ts[-1] + self.gap + SHIFT) * 1000) + 1)
        # a track that nothing can join any more ends
        on = [t for t, seen in enumerate(tracks.seen) if now - seen <= self.gap]
        if len(ids) or len(on) < len(tracks.seen):
            self.open.clear()
            if on:
                self.open.update(_pack([tracks.ids[t] for t in on], np.column_stack([[tracks.seen[t] for t in on], [tracks.boxes[t] for t in on], tracks.looks[on]])))
        if len(ids):
            yield pd.DataFrame({self.by: np.full(len(ids), key[0]), "id": ids, "track": found})

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, by: str = "media_id", late: str = "10 seconds", gap: float = TRACK_GAP) -> DataFrame:
    """(by, id, track) of a stream of detections (by, id, ts, bbox, vec, detection and, where known, quality), once the watermark is past them.

    ``ts`` are seconds; the watermark runs over them as times since 1970-01-02.  Needs the state store ``PROVIDER``.
    """
    quality = F.coalesce("quality", "detection") if "quality" in detections.columns else F.col("detection")
    rows = detections.select(by, "id", F.col("ts").cast("double").alias("ts"), F.col("bbox").cast("array<double>").alias("bbox"), F.col("vec").cast("array<double>").alias("vec"), quality.cast("double").alias("q"))
    rows = rows.withColumn("at", (F.ceil((F.col("ts") + SHIFT) * 1000) * 1000).cast("long"))
    packed = rows.mapInArrow(_packer(by), f"{by} long, at long, ids binary, rows binary")
    packed = packed.withColumn("at", F.timestamp_micros("at")).withWatermark("at", late)
    return packed.groupBy(by).transformWithStateInPandas(Tracker(by, gap), f"{by} long, id long, track long", "Append", "EventTime")
