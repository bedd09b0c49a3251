"""Who met whom: pairs of people by any two of their faces, where faces may meet many times for each pair.

People who meet do so some forty times over, so pairs of faces are never shuffled.  People are laid out by where they are seen along x
and cut into cells of a bounded number of people and faces; a task has two cells and the table of their pairs, goes through
their videos slice by slice, and looks only for pairs that are still open.  Cells that lie too far apart do not meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

PEOPLE, FACES, FEW_FACES = 2048, 1 << 20, 1 << 17  # of a cell at most, but for one person's own faces; fewer faces where there are few in all
SLICE, NEAR, PAIRS = 1 << 16, 512, 1 << 20  # faces of a cell, people and pairs of faces that are looked at together, about
TASKS = 4096  # of the last step at most; a task then has several pairs of cells
COLUMNS = ["place", "person_id", "media_id", "timestamp", "cx", "cy", "r"]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for every number from ``low`` up to ``high`` of each row."""
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


class Shelf:
    """Faces of some people by video, slot of time and strip of x, each in the order of y."""

    def __init__(self, faces: dict[str, np.ndarray], seconds: float):
        self.seconds, x, r = seconds, faces["cx"], faces["r"]
        fine = np.isfinite(x)
        self.low, self.high = (x[fine].min(), x[fine].max()) if fine.any() else (np.inf, -np.inf)
        sure = r[np.isfinite(r) & (r > 0)]
        self.width = max(sure.mean() if len(sure) else 1.0, (self.high - self.low) / 64 if fine.any() else 0.0, 1e-300)
        self.media, m = np.unique(faces["media_id"], return_inverse=True)
        self.slots, t = np.unique(np.floor(faces["timestamp"] / (2 * seconds)), return_inverse=True)
        self.strips, s = np.unique(np.floor(np.where(fine, x, 0.0) / self.width), return_inverse=True)
        self.ys, y = np.unique(faces["cy"], return_inverse=True)
        self.cells, c = np.unique((m * len(self.slots) + t) * len(self.strips) + s, return_inverse=True)
        key = c * (len(self.ys) + 1) + y
        order = np.argsort(key, kind="stable")
        self.keys, self.faces = key[order], {k: v[order] for k, v in faces.items()}

    def meet(self, big: dict[str, np.ndarray], still: np.ndarray) -> None:
        """Closes in ``still`` the pairs (person of ``big``, own person) of which a face of ``big`` reaches an own face.

        Ranges are a little wide; what they hold is judged exactly.  A size that is infinite or no number reaches everything.
        """
        rows = still.any(axis=1)
        if not rows.any():
            return
        wide = ~(big["r"] < np.inf)
        off = np.maximum(np.maximum(self.low - big["cx"], big["cx"] - self.high), 0)
        on = rows[big["place"]] & (wide | (big["r"] >= off * (1 - 1e-9)))
        at = np.minimum(np.searchsorted(self.media, big["media_id"]), len(self.media) - 1)
        on &= self.media[at] == big["media_id"]
        if not on.any():
            return
        p, t, x, y, r = (big[k][on] for k in ("place", "timestamp", "cx", "cy", "r"))
        wide, off, at = wide[on], off[on], at[on]
        by = self.seconds * (1 + 1e-9) + 1e-15 * np.abs(t)
        i, slot = _spread(np.searchsorted(self.slots, np.floor((t - by) / (2 * self.seconds))), np.searchsorted(self.slots, np.floor((t + by) / (2 * self.seconds)), "right"))
        by = r * (1 + 1e-7) + 1e-15 * np.abs(x)
        first = np.where(wide, 0, np.searchsorted(self.strips, np.floor((x - by) / self.width)))
        last = np.where(wide, len(self.strips), np.searchsorted(self.strips, np.floor((x + by) / self.width), "right"))
        k, strip = _spread(first[i], last[i])
        i, slot = i[k], slot[k]
        code = (at[i] * len(self.slots) + slot) * len(self.strips) + strip
        cell = np.minimum(np.searchsorted(self.cells, code), len(self.cells) - 1)
        there = self.cells[cell] == code
        i, cell = i[there], cell[there]
        by = np.sqrt(np.maximum(r - off, 0)) * np.sqrt(np.maximum(r + off, 0)) + 1e-7 * np.abs(r) + 1e-15 * np.abs(y)
        base = cell * (len(self.ys) + 1)
        low = np.searchsorted(self.keys, base + np.where(wide, 0, np.searchsorted(self.ys, y - by))[i])
        high = np.searchsorted(self.keys, base + np.where(wide, len(self.ys), np.searchsorted(self.ys, y + by, "right"))[i])
        sums, start = np.cumsum(high - low), 0
        while start < len(i):
            stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + PAIRS, "right")))
            a, j = _spread(low[start:stop], high[start:stop])
            a = i[start:stop][a]
            left = np.flatnonzero(still[p[a], self.faces["place"][j]])
            a, j = a[left], j[left]
            gap = np.abs(t[a] - self.faces["timestamp"][j])
            left = np.flatnonzero((gap > 0) & (gap <= self.seconds))
            a, j = a[left], j[left]
            far = np.hypot(x[a] - self.faces["cx"][j], y[a] - self.faces["cy"][j])
            ok = (far <= r[a]) | np.isnan(r[a])
            still[p[a[ok]], self.faces["place"][j[ok]]] = False
            start = stop


def _pack(t: pa.Table) -> pa.Table:
    rows = t.select(COLUMNS).combine_chunks()
    rows = rows.take(np.lexsort((rows["cy"].to_numpy(), rows["media_id"].to_numpy(), rows["place"].to_numpy() // NEAR)))  # like beside like, for less to send
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return pa.table({"cell_cx": t["cell_cx"][:1], "slice": t["slice"][:1], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    rows = pa.ipc.open_stream(blob).read_all()
    return {c: rows[c].to_numpy() for c in COLUMNS}


def _near(faces: dict[str, np.ndarray]) -> dict[int, dict[str, np.ndarray]]:
    """Faces by runs of ``NEAR`` people, with the places in the run; they come run by run."""
    run = faces["place"] // NEAR
    cuts = np.flatnonzero(np.diff(run)) + 1
    parts = {int(run[s[0]]): {k: v[s[0] : s[-1] + 1] for k, v in faces.items()} for s in np.split(np.arange(len(run)), cuts) if len(s)}
    return {g: part | {"place": part["place"] - g * NEAR} for g, part in parts.items()}


def _meetings(seconds: float):
    def run(t: pa.Table) -> pa.Table:
        a, b, na, nb = (t[c][0].as_py() for c in ("cell_cx", "cell_cx_b", "people", "people_b"))
        blobs = {(s, own): k for k, (s, own) in enumerate(zip(t["slice"].to_pylist(), t["own"].to_pylist(), strict=True))}
        still, ids = np.ones((na, nb), bool), (np.zeros(na, np.int64), np.zeros(nb, np.int64))
        if a == b:
            np.fill_diagonal(still, False)
        open_ = {(i, j): still[i * NEAR : (i + 1) * NEAR, j * NEAR : (j + 1) * NEAR].copy() for i in range(-(-na // NEAR)) for j in range(-(-nb // NEAR)) if a != b or i <= j}
        del still
        for s in sorted({s for s, _ in blobs}):
            faces = [_unpack(t["rows"][blobs[s, own]].as_py()) if (s, own) in blobs else None for own in ((a,) if a == b else (a, b))]
            if None in faces:
                continue
            for known, f in zip(ids, (faces[0], faces[-1]), strict=True):
                known[f["place"]] = f["person_id"]
            left = {i: Shelf(f, seconds) for i, f in _near(faces[0]).items()}
            right = left if a == b else {j: Shelf(f, seconds) for j, f in _near(faces[1]).items()}
            for (i, j), pairs in open_.items():
                if i in left and j in right:
                    right[j].meet(left[i].faces, pairs)
                    if a == b and i == j:
                        pairs &= pairs.T.copy()
                    else:
                        left[i].meet(right[j].faces, pairs.T)
        out = []
        for (i, j), pairs in open_.items():
            met = ~pairs
            if a == b and i == j:
                met = np.triu(met, 1)
            p, q = np.nonzero(met)
            p, q = ids[0][i * NEAR + p], ids[1][j * NEAR + q]
            out.append(pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"]))
        return pa.Table.from_batches(out)

    return run


def meetings(faces: DataFrame, seconds: float) -> DataFrame:
    """(a, b), a < b, of people of whom two faces (person_id, media_id, timestamp, cx, cy, r) of one video lie within ``seconds``, not at one time, and within the larger ``r``."""
    tables = Scratch(faces.sparkSession)
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    rows = faces.where("person_id is not null and media_id is not null and cx is not null and cy is not null and r is not null").where(finite("timestamp"))
    rows = rows.select(*(F.col(c).cast("long") for c in ("person_id", "media_id")), *(F.col(c).cast("double") for c in COLUMNS[3:]))
    inside = F.when(finite("cx"), F.col("cx"))
    who = tables.write(rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("at"), F.min(inside).alias("low"), F.max(inside).alias("high"), F.max("r").alias("reach")))
    many, total, most = who.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    size = min(FACES, max(FEW_FACES, total // 8))
    slices = 1 + max(size, most) // SLICE if total > SLICE else 1
    # a part's people in order, cut where their weights have come to one more
    laid = who.repartitionByRange(1 + many // 100_000, "at", "person_id").withColumn("part", F.spark_partition_id().cast("long"))
    order = Window.partitionBy("part").orderBy("at", "person_id")
    weight = F.greatest(F.col("n") / size, F.lit(1.0 / PEOPLE))
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    laid = tables.write(laid.withColumn("cell_cx", F.col("part") * (1 << 32) + F.floor(before + 1e-9)))
    places = tables.write(laid.select("person_id", "cell_cx", (F.row_number().over(Window.partitionBy("cell_cx").orderBy("at", "person_id")) - 1).alias("place")))
    cells = laid.groupBy("cell_cx").agg(F.count(F.lit(1)).alias("people"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("reach").alias("reach"))
    other = cells.select(*(F.col(c).alias(f"{c}_b") for c in cells.columns))
    apart = F.coalesce(F.greatest(F.col("low") - F.col("high_b"), F.col("low_b") - F.col("high")), F.lit(0.0)) * (1 - 1e-9)
    pairs = cells.join(other, (F.col("cell_cx") <= F.col("cell_cx_b")) & (apart <= F.greatest("reach", "reach_b"))).select("cell_cx", "cell_cx_b", "people", "people_b")
    pairs = tables.write(pairs.withColumn("own", F.explode(F.array_distinct(F.array("cell_cx", "cell_cx_b")))))
    packed = rows.join(places, "person_id").withColumn("slice", F.pmod(F.xxhash64("media_id"), F.lit(slices)).cast("int"))
    packed = tables.write(packed.groupBy("cell_cx", "slice").applyInArrow(_pack, "cell_cx long, slice int, rows binary"))
    tasks = max(1, min(TASKS, pairs.count()))
    met = packed.withColumnRenamed("cell_cx", "own").join(pairs, "own").repartition(tasks, "cell_cx", "cell_cx_b")
    return met.groupBy("cell_cx", "cell_cx_b").applyInArrow(_meetings(seconds), "a long, b long")
