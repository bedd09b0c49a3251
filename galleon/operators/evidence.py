"""The pairs of people most likely to be one: a top-k join by bounds, without comparing all pairs.

A person is a centre and a few crops, none of which is further from the centre than the
person's radius.  So the angle between two centres bounds the best pair of crops, and with it
the score.  People lie in inverted lists around fitted centres; a list's widest angle and
largest radius bound the score of a person with anyone in it.

Visits of people to lists are worked off best bound first, in rounds.  After each the k-th
best score is known, and when no visit left could beat it the join ends.  Within a visit
only pairs whose own bound can beat it have their crops compared.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import ann
from .windows import top_n

# Fixed values of the semantics.
MIN_QUALITY, MIN_DETECTION, CROPS = 0.40, 0.70, 12
CENTRE_FLOOR, CENTRE_LESS, CROP_FLOOR, CROP_MORE = 0.40, 0.08, 0.50, 0.02
BEST_SHARE, CENTRE_SHARE = 0.6, 0.4
CHECKED, SHOWN = 600, 60
SLACK = 1e-9

LEAST_LISTS, LIST_PEOPLE = 32, 4096  # no more lists than these ask for: a person is sent to every list that may hold a partner
VISITORS = 32_768  # people that a task compares with its block, about
COPIES, SENT = 1_000_000, 2048  # rows that are dealt, and sent, at once
CELLS = 1 << 22  # numbers in an array of comparisons, about
DENSE = 0.05  # share of allowed pairs from which all crops of a block are compared at once

PAIRS = "a long, b long, centroid double, best double, top3 double, score double, compared long"


class Suggestions(NamedTuple):
    """Pairs (a, b, score, confidence, centroid, best_crop, top3), best first, and how many were compared or dropped, and why."""

    pairs: DataFrame
    counts: dict[str, int]


def crops(faces: DataFrame) -> DataFrame:
    """The best crop of every appearance, at most ``CROPS`` of a person: (person_id, face_id, vec).

    Faces are (person_id, media_id, track_id, face_id, vec, quality, detection, usable).
    """
    rows = faces.where((F.col("quality") >= MIN_QUALITY) & (F.col("detection") >= MIN_DETECTION) & F.col("person_id").isNotNull())
    rows = rows.withColumn("_track", F.coalesce("track_id", -F.col("face_id")))
    best = [F.desc("quality"), F.desc("detection"), F.asc("face_id")]
    rows = top_n(top_n(rows, ["person_id", "media_id", "_track"], best), ["person_id"], [F.desc("quality"), F.asc("face_id")], CROPS)
    return rows.where("usable").select("person_id", "face_id", "vec")


def _centred(batches):
    """Unit crops, their mean as centre, and the widest angle between them."""
    for b in batches:
        size = pc.list_value_length(b.column("crops")).to_numpy(zero_copy_only=False)
        v = ann.matrix(b.column("crops").flatten())
        ends, centres, radius = np.cumsum(size), [], []
        for n, e in zip(size.tolist(), ends.tolist(), strict=True):
            mine = v[e - n : e]
            c = mine.mean(0)
            c /= max(np.linalg.norm(c), 1e-300)
            centres.append(c.tolist())
            radius.append(float(np.arccos(np.clip((mine @ c).min(), -1, 1))))
        yield pa.RecordBatch.from_arrays([b.column("person_id"), pa.array(centres, pa.list_(pa.float64())), pa.array(radius), b.column("crops")], ["person_id", "embedding", "radius", "crops"])


def bound(angle: np.ndarray, crop: np.ndarray | float, centre: np.ndarray | float = 0.0) -> np.ndarray:
    """The most that a score can be where centres are ``angle`` apart, less the slack of crops and of centres."""
    return BEST_SHARE * np.cos(np.maximum(0, angle - crop - centre)) + CENTRE_SHARE * np.cos(np.maximum(0, angle - centre)) + SLACK


def _exact(v: np.ndarray, flat: np.ndarray, starts: np.ndarray, size: np.ndarray, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, best, top3) of pairs of people, by sums that do not depend on where in a block a pair stands."""
    centroid, best, top3 = np.empty(len(i)), np.empty(len(i)), np.empty(len(i))
    shape = size[i] * (CROPS + 1) + size[k]
    for kind in np.unique(shape).tolist():
        p, q = divmod(kind, CROPS + 1)
        of = np.flatnonzero(shape == kind)
        for at in np.array_split(of, -(-len(of) * (p + q) * flat.shape[1] // CELLS)):
            x, y = flat[starts[i[at]][:, None] + np.arange(p)], flat[starts[k[at]][:, None] + np.arange(q)]
            cross = np.sort(np.einsum("nad,nbd->nab", x, y).reshape(len(at), -1), axis=1)[:, ::-1]
            centroid[at] = np.clip(np.einsum("nd,nd->n", v[i[at]], v[k[at]]), -1, 1)
            best[at], top3[at] = cross[:, 0], cross[:, :3].mean(1)
    return centroid, best, top3


def _meet(centre_floor: float, crop_floor: float, least: float, inner: bool, checked: int):
    """Members of a block (each other too where ``inner``) and its visitors: the ``checked`` best pairs of them.

    Where few pairs' bounds allow it, only those are compared; else all crops meet in one matrix
    product and what can be among the best is compared again.
    """

    def run(t: pa.Table) -> pa.Table:
        side, ids, radius = t["side"].to_numpy(), t["person_id"].to_numpy(), t["radius"].to_numpy()
        v, floor, compared = ann.matrix(t["embedding"]), least, 0
        size = pc.list_value_length(t["crops"]).to_numpy().astype(np.int64)
        flat = ann.matrix(pa.concat_arrays([c.flatten() for c in t["crops"].chunks]))
        starts = np.cumsum(size) - size
        rows = lambda who: np.repeat(starts[who] - np.cumsum(size[who]) + size[who], size[who]) + np.arange(size[who].sum())
        y = np.flatnonzero(side == 0)
        first = inner and t["slice"][0].as_py() == 0  # a block meets itself once
        x = np.flatnonzero((side == 1) | first) if len(y) else y
        vy, fy = v[y], flat[rows(y)]
        sy = np.cumsum(size[y]) - size[y]
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0) for _ in range(4))]  # a, b, centroid, best, top3, score
        for i in np.split(x, np.flatnonzero(np.diff(np.cumsum(size[x]) // max(1, CELLS // max(1, len(fy))))) + 1) if len(x) else []:
            cos = np.clip(v[i] @ vy.T, -1, 1)
            near = np.cos(np.maximum(0, np.arccos(cos) - radius[i][:, None] - radius[y][None, :]))
            can = BEST_SHARE * near + CENTRE_SHARE * cos + SLACK >= floor
            can &= (cos >= centre_floor - SLACK) | (near + SLACK >= crop_floor)
            can &= np.where((side[i] == 0)[:, None], ids[y][None, :] < ids[i][:, None], ids[y][None, :] != ids[i][:, None])
            n = int(can.sum())
            compared += n
            if n > DENSE * can.size:
                cross = np.maximum.reduceat(flat[rows(i)] @ fy.T, np.cumsum(size[i]) - size[i], axis=0)
                best = np.maximum.reduceat(cross, sy, axis=1)
                score = BEST_SHARE * best + CENTRE_SHARE * cos
                can &= (score >= floor - SLACK) & ((cos >= centre_floor - SLACK) | (best >= crop_floor - SLACK))
                sure = score[can & ((cos >= centre_floor + SLACK) | (best >= crop_floor + SLACK))]
                if len(sure) > checked:
                    can &= score >= np.partition(sure, -checked)[-checked] - SLACK
            p, q = np.nonzero(can)
            p, q = i[p], y[q]
            centroid, best, top3 = _exact(v, flat, starts, size, p, q)
            score = BEST_SHARE * best + CENTRE_SHARE * centroid
            ok = ((centroid >= centre_floor) | (best >= crop_floor)) & (score >= floor)
            new = (np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), centroid, best, top3, score)
            held = [np.concatenate((h, c[ok])) for h, c in zip(held, new, strict=True)]
            if len(held[0]) > checked:
                top = np.lexsort((held[1], held[0], -held[5]))[:checked]
                held = [h[top] for h in held]
                floor = max(floor, float(held[5][-1]))
        ends = (-1, -1, 0.0, 0.0, 0.0, 0.0)
        table = {c: np.append(h, e) for c, h, e in zip(("a", "b", "centroid", "best", "top3", "score"), held, ends, strict=True)}
        return pa.table(table | {"compared": np.append(np.zeros(len(held[0]), np.int64), compared)})

    return run


def suggest(faces: DataFrame, threshold: float, separate: DataFrame, together: DataFrame, checked: int = CHECKED, shown: int = SHOWN, lists: int | None = None, block_rows: int = 4096, step: float = 0.1) -> Suggestions:
    """The ``shown`` likeliest pairs among the ``checked`` best, less those marked ``separate`` (a, b) or seen ``together`` (a, b).

    The best are exactly those of comparing all pairs, in the order of score, a and b.
    """
    spark = faces.sparkSession
    tables = Scratch(spark)
    centre_floor, crop_floor = max(CENTRE_FLOOR, threshold - CENTRE_LESS), max(CROP_FLOOR, threshold + CROP_MORE)
    chosen = crops(faces).groupBy("person_id").agg(F.collect_list("vec").alias("crops"))  # at most CROPS
    people = tables.write(chosen.select("person_id", F.col("crops").cast("array<array<double>>").alias("crops")).mapInArrow(_centred, "person_id long, embedding array<double>, radius double, crops array<array<double>>"))
    n, known = people.count(), faces.where("person_id is not null").select("person_id").distinct().count()
    counts = {"people": known, "people_with_crops": n, "no_usable_crops": known - n, "pairs": n * (n - 1) // 2, "pairs_compared": 0, "marked_separate": 0, "same_frame": 0}
    index = ann.build(people, lists or max(1, min(round(n**0.5), max(LEAST_LISTS, n // LIST_PEOPLE))), "person_id", "embedding")
    home = tables.write(people.join(index.rows.select(F.col("id").alias("person_id"), "list", "angle"), "person_id"))
    about = {r["list"]: r for r in home.groupBy("list").agg(F.max("angle").alias("wide"), F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    k = len(index.centres)
    wide, most = (np.array([about[i][c] if i in about else -np.inf for i in range(k)]) for c in ("wide", "radius"))
    parts = np.array([max(1, -(-(about[i]["n"] if i in about else 0) // block_rows)) for i in range(k)])
    centres = index.centres
    slices = max(1, -(-n // VISITORS))
    rows_at_once = max(1, min(1024, COPIES // int(parts.sum())))
    mixed = lambda ids: ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def visits(low: float, high: float):
        """Visits whose bound is in [low, high): to lists before the person's own, and to the person's own."""

        def run(batches):
            for b in (whole.slice(at, rows_at_once) for whole in batches for at in range(0, whole.num_rows, rows_at_once)):
                v, of, radius, ids = ann.matrix(b.column("embedding")), b.column("list").to_numpy(), b.column("radius").to_numpy(), b.column("person_id").to_numpy()
                angle = np.arccos(np.clip(v @ centres.T, -1, 1))
                top = np.where(np.isfinite(wide)[None, :], bound(angle, radius[:, None] + np.maximum(most, 0)[None, :], np.maximum(wide, 0)[None, :]), -np.inf)
                goes = (top >= low) & (top < high) & (np.arange(k)[None, :] <= of[:, None])
                i, to = np.nonzero(goes)
                m = parts[to]
                part = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                i, to = np.repeat(i, m), np.repeat(to, m)
                ask = (to != of[i]) | (part < ids[i] % parts[to])  # blocks of one list meet once
                i, to, part = i[ask], to[ask], part[ask]
                for at in range(0, len(i), SENT):
                    x, y, z = i[at : at + SENT], to[at : at + SENT], part[at : at + SENT]
                    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(z, pa.int32()), pa.array(mixed(ids[x]) % slices, pa.int32()), pa.array(np.ones(len(x)), pa.int32()), *(b.column(c).take(pa.array(x)) for c in ("person_id", "embedding", "radius", "crops"))], ["list", "part", "slice", "side", "person_id", "embedding", "radius", "crops"])

        return run

    schema = "list int, part int, slice int, side int, person_id long, embedding array<double>, radius double, crops array<array<double>>"
    of_list = F.create_map(*(F.lit(x) for i in range(k) for x in (i, int(parts[i]))))
    members = home.select("list", F.pmod("person_id", of_list[F.col("list")]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("side"), "person_id", "embedding", "radius", "crops")
    tasks = int(min(1024, parts.sum() * slices))  # by number: merged by bytes, few tasks would compare much
    found, high, number = None, np.inf, 0
    floor = BEST_SHARE * -1.0 + CENTRE_SHARE * -1.0
    kth, low = floor, 1.0 + SLACK - step
    while high > floor and high > kth:
        number += 1
        come = home.select("list", "person_id", "embedding", "radius", "crops").mapInArrow(visits(low, high), schema)
        # members of a block meet each other in the first round
        if number == 1:
            held = members
        else:
            come = tables.write(come)
            held = members.join(come.select("list", "part", "slice").distinct(), ["list", "part", "slice"], "left_semi").select(*members.columns)
        both = held.unionByName(come).repartition(tasks, "list", "part", "slice")
        met = both.groupBy("list", "part", "slice").applyInArrow(_meet(centre_floor, crop_floor, kth, number == 1, checked), PAIRS)
        found = tables.append(met, "found", str(number))
        good = found.where("a >= 0").orderBy(F.desc("score"), "a", "b").limit(checked)
        now = good.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        kth = now["s"] if now["n"] >= checked else kth
        if number > 1:
            tables.drop(come)
        high, low = low, max(floor, low - step) if low - step > floor else -np.inf
    counts["pairs_compared"] = found.agg(F.sum("compared")).first()[0] or 0
    keep = Scratch(spark)
    best = keep.write(found.where("a >= 0").orderBy(F.desc("score"), "a", "b").limit(checked).drop("compared"))
    tables.drop()
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    apart = best.join(pair(separate), ["a", "b"], "left_semi")
    left = best.join(pair(separate), ["a", "b"], "left_anti")
    counts["marked_separate"], counts["same_frame"] = apart.count(), left.join(pair(together), ["a", "b"], "left_semi").count()
    sure = (F.col("best") >= 0.62) & (F.col("centroid") >= 0.52) & (F.col("top3") >= 0.55)
    fair = (F.col("best") >= 0.54) & ((F.col("centroid") >= 0.46) | (F.col("top3") >= 0.48))
    shown_rows = left.join(pair(together), ["a", "b"], "left_anti").orderBy(F.desc("score"), "a", "b").limit(shown)
    named = F.when(sure, "high").when(fair, "medium").otherwise("low")
    return Suggestions(shown_rows.select("a", "b", "score", named.alias("confidence"), "centroid", F.col("best").alias("best_crop"), "top3"), counts)
