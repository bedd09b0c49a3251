"""Faces and frames in the order of time or quality: keyframes, re-detections, references, automatic merging.

Groups are one video, one person or one component of similar people; inputs are cut to
bounded numbers of rows a group first where a rule allows it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ann, graph, vectors, windows
from .sequences import pair_overlaps


def keyframes(frames: DataFrame, by: str = "media_id", cut: float = 0.3, least: float = 1.0, most: float = 30.0) -> DataFrame:
    """(by, t) of frames (by, t, scene) that are kept: the first, a new scene after ``least`` seconds, anything after ``most``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, keep = pdf.sort_values("t"), -math.inf, []
        for t, scene in zip(pdf["t"], pdf["scene"], strict=True):
            ok = t - last >= most or (scene > cut and t - last >= least)
            keep.append(ok)
            last = t if ok else last
        return pdf.loc[keep, [by, "t"]]

    return frames.groupBy(by).applyInPandas(run, f"{by} long, t double")


def adaptive_samples(frames: DataFrame, interval: float, by: str = "media_id") -> DataFrame:
    """(by, t) of frames (by, t, diff) that are looked at: sooner after much change since the last one, later after little."""
    short, long = max(0.33, interval / 3), interval * 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, due, keep = pdf.sort_values("t"), 0.0, []
        for t, diff in zip(pdf["t"], pdf["diff"], strict=True):
            ok = t + 1e-6 >= due
            keep.append(ok)
            if ok:
                known = diff is not None and not math.isnan(diff) and sum(keep) > 1
                step = max(short, interval * 0.4) if known and diff > 0.08 else min(long, interval * 1.8) if known and diff < 0.015 else interval
                due = t + step
        return pdf.loc[keep, [by, "t"]]

    return frames.groupBy(by).applyInPandas(run, f"{by} long, t double")


def _matrix(column: pd.Series, width: int = 0) -> np.ndarray:
    """Lists of one length as rows; null is a row of zeros."""
    have = column.notna().to_numpy()
    some = np.array(column[have].tolist(), float).reshape(have.sum(), -1) if have.any() else np.zeros((0, width))
    out = np.zeros((len(column), some.shape[1]))
    out[have] = some
    return out


SLACK = 1e-6  # around windows of time, which are judged exactly afterwards
PAIRS = 500_000  # that are compared at once; one new face and all old ones of its time at least


def pick_redetections(pdf: pd.DataFrame, by: str, threshold: float, near: float, overlap: float) -> pd.DataFrame:
    """The choices of one group's new faces: each is compared only with the old ones of its time, equal ones going to the least id."""
    a, b = pdf[pdf["known"]].sort_values("timestamp", kind="stable"), pdf[~pdf["known"]].sort_values("id")
    boxes, looks, keys, ta = _matrix(a["bbox"], 4), _matrix(a["embedding"]), a["id"].to_numpy(), a["timestamp"].to_numpy(float)
    new_boxes, new_looks, tb = _matrix(b["bbox"], 4), _matrix(b["embedding"]), b["timestamp"].to_numpy(float)
    timed, taken, found, start = int((~np.isnan(ta)).sum()), np.zeros(len(a), bool), np.full(len(b), -1), 0
    # old faces of a new one's time stand side by side; those without a time are last
    low = np.where(np.isnan(tb), timed, np.searchsorted(ta[:timed], tb - near - SLACK, "left"))
    many = np.where(np.isnan(tb), len(a), np.searchsorted(ta[:timed], tb + near + SLACK, "right")) - low
    ends = np.cumsum(many)
    while start < len(b):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = many[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = np.repeat(low[start:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = ~taken[j] & ((np.abs(ta[j] - tb[i]) <= near) | np.isnan(tb[i]))
        i, j = i[ok], j[ok]
        shared = pair_overlaps(new_boxes[i], boxes[j])
        alike = np.einsum("ij,ij->i", new_looks[i], looks[j]) if new_looks.shape[1] and looks.shape[1] else np.zeros(len(i))
        ok = (shared >= overlap) & (alike >= threshold)
        i, j, score = i[ok], j[ok], (shared + alike)[ok]
        for k in np.lexsort((keys[j], -score, i)).tolist():
            if found[i[k]] < 0 and not taken[j[k]]:
                found[i[k]], taken[j[k]] = j[k], True
        start = stop
    out = [(m, key, int(keys[f]) if f >= 0 else None) for m, key, f in zip(b[by], b["id"], found, strict=True)]
    return pd.DataFrame(out, columns=[by, "id", "old_id"]).astype({"old_id": "Int64"})


def redetections(old: DataFrame, new: DataFrame, threshold: float, by: str = "media_id", near: float = 0.001, overlap: float = 0.55) -> DataFrame:
    """(by, id, old_id): which known face a face found again is, null if none.

    Both are (by, id, timestamp, bbox, embedding).  New faces choose in the order of their
    ids among the old ones of their time that overlap and look alike, the best sum of both;
    an old face is used once.
    """
    cols = [by, "id", "timestamp", "bbox", "embedding"]
    rows = old.select(*cols).withColumn("known", F.lit(True)).unionByName(new.select(*cols).withColumn("known", F.lit(False)))
    pick = lambda pdf: pick_redetections(pdf, by, threshold, near, overlap)
    return rows.groupBy(by).applyInPandas(pick, f"{by} long, id long, old_id long")


def track_edges(tracks: DataFrame, probes: DataFrame, by: str = "media_id", alike: float = 0.5, quality: float = 0.35) -> DataFrame:
    """(by, track, id): faces (by, id, ts, vec, quality) found just outside a track (by, track, first_ts, last_ts, vec) that look like it.

    At each time tracks choose in the order of their numbers, and a face goes to one track.
    """
    near = probes.where(F.col("quality") >= quality).select(by, "id", "ts", F.col("vec").alias("_v"))
    rows = tracks.join(near, by).where((F.col("ts") < F.col("first_ts")) | (F.col("ts") > F.col("last_ts")))
    rows = rows.withColumn("s", vectors.dot(F.col("vec"), F.col("_v"))).where(F.col("s") >= alike).select(by, "ts", "track", "id", "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, done, out = set(), set(), []
        for track, face in zip(*(pdf.sort_values(["track", "s", "id"], ascending=[True, False, True])[c] for c in ("track", "id")), strict=True):
            if track not in done and face not in taken:
                done.add(track)
                taken.add(face)
                out.append((pdf[by].iloc[0], track, face))
        return pd.DataFrame(out, columns=[by, "track", "id"])

    return rows.groupBy(by, "ts").applyInPandas(run, f"{by} long, track long, id long")


def distinct_crops(faces: DataFrame, limit: int = 32, same: float = 0.97, by: str = "person_id") -> DataFrame:
    """(by, face_id) of each person's best crops (by, face_id, embedding, quality), none nearly the same as a better one."""
    rows = windows.top_n(faces, [by], [F.desc("quality"), F.asc("face_id")], 2 * limit)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["quality", "face_id"], ascending=[False, True])
        return pdf.iloc[distinct_rows(_matrix(pdf["embedding"]), same, limit)][[by, "face_id"]]

    return rows.select(by, "face_id", "embedding", "quality").groupBy(by).applyInPandas(run, f"{by} long, face_id long")


def distinct_rows(v: np.ndarray, same: float, limit: int) -> list[int]:
    """Rows in order, without those too like an earlier kept one."""
    like, keep = v @ v.T, []
    for i in range(len(v)):
        if len(keep) < limit and (like[i, keep] < same).all():
            keep.append(i)
    return keep


def references(faces: DataFrame, limit: int = 6, same: float = 0.98, replace: bool = True, by: str = "person_id", order: str = "seq") -> DataFrame:
    """(by, face_id) of the views remembered of each person, over faces (by, face_id, seq, embedding, quality) in order.

    A view nearly the same as a remembered one takes its place if it is better (or is
    passed over, without ``replace``); of others the best ``limit`` are remembered.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "face_id"])
        v, q, held = _matrix(pdf["embedding"]), pdf["quality"].to_numpy(float), []
        for i in range(len(v)):
            twin = next((k for k, j in enumerate(held) if v[i] @ v[j] >= same), None)
            if twin is None:
                held = sorted([*held, i], key=lambda j: -q[j])[:limit]
            elif replace and q[i] > q[held[twin]]:
                held[twin] = i
        return pdf.iloc[held][[by, "face_id"]]

    return faces.select(by, "face_id", order, "embedding", "quality").groupBy(by).applyInPandas(run, f"{by} long, face_id long")


# Fixed values of automatic merging: best pair, mean of the best three, centres; seconds, bonus, sizes, and caps of learned floors.
LEVELS = {"conservative": (0.62, 0.56, 0.50), "balanced": (0.56, 0.50, 0.44), "aggressive": (0.52, 0.46, 0.40)}
SPLIT_SECONDS, SPLIT_SIZES, SPLIT_BONUS = 12.0, 0.6, 0.04
CROPS, SAME_CROP = 32, 0.97


class Person:
    """A person or several merged ones: crops by quality, where they were seen, names."""

    def __init__(self, rows: pd.DataFrame):
        first = rows.iloc[0]
        self.id, self.size, self.version, self.members = int(first["person_id"]), int(first["faces"]), 0, {int(first["person_id"])}
        name = (first["name"] or "").strip().lower()
        self.names = {name} if name else set()
        self.apart, self.seen = {k for some in rows["apart"] for k in some}, {tuple(k) for some in rows["seen"] for k in some}
        self.settle(rows.sort_values(["quality", "face_id"], ascending=[False, True]))

    def settle(self, rows: pd.DataFrame) -> None:
        v = _matrix(rows["embedding"])
        keep = distinct_rows(v, SAME_CROP, CROPS)
        self.rows, self.v = rows.iloc[keep], v[keep]
        self.centre = self.v.mean(axis=0)
        self.centre /= max(np.linalg.norm(self.centre), 1e-12)
        self.where = self.rows[["media_id", "timestamp", "cx", "cy", "size"]].to_numpy(float)

    def split_by_tracking(self, other: Person) -> bool:
        """Whether both were seen in one video within seconds and at nearly one place."""
        a, b = self.where[:, None, :], other.where[None, :, :]
        gap = np.abs(a[..., 1] - b[..., 1])
        near = np.hypot(a[..., 2] - b[..., 2], a[..., 3] - b[..., 3]) <= SPLIT_SIZES * np.maximum(a[..., 4], b[..., 4])
        return bool(((a[..., 0] == b[..., 0]) & (gap > 0) & (gap <= SPLIT_SECONDS) & near).any())

    def score(self, other: Person, floors: tuple[float, float, float]) -> float | None:
        """How much speaks for a merge; null if a floor is not reached."""
        pairs = np.sort((self.v @ other.v.T).ravel())[::-1]
        found = pairs[0], pairs[:3].mean(), self.centre @ other.centre
        bonus = SPLIT_BONUS if self.split_by_tracking(other) else 0.0
        if any(x + bonus < f for x, f in zip(found, floors, strict=True)):
            return None
        return float(0.3 * found[0] + 0.5 * found[1] + 0.2 * found[2] + bonus)

    def barred(self, other: Person) -> bool:
        """Different names, kept apart by the user, or seen together in one frame."""
        named = bool(self.names and other.names and not self.names & other.names)
        return named or bool(self.apart & other.members or other.apart & self.members) or bool(self.seen & other.seen)

    def absorb(self, other: Person) -> None:
        self.members |= other.members
        self.apart, self.seen, self.names = self.apart | other.apart, self.seen | other.seen, self.names | other.names
        self.size, self.version = self.size + other.size, self.version + 1
        self.settle(pd.concat([self.rows, other.rows]).sort_values(["quality", "face_id"], ascending=[False, True]))


def merge_best_first(people: list[Person], floors: tuple[float, float, float]) -> list[tuple[int, int, float]]:
    """(source, target, score): merges in the order they are made, the best one first, everything judged anew after each."""
    live, heap, out = {p.id: p for p in people}, [], []

    def offer(a: Person, b: Person) -> None:
        score = a.score(b, floors)
        if score is not None:
            heapq.heappush(heap, (-score, *sorted((a.id, b.id)), live[min(a.id, b.id)].version, live[max(a.id, b.id)].version))

    for i, a in enumerate(people):
        for b in people[i + 1 :]:
            offer(a, b)
    while heap:
        score, i, j, vi, vj = heapq.heappop(heap)
        if i not in live or j not in live or (live[i].version, live[j].version) != (vi, vj) or live[i].barred(live[j]):
            continue
        keep, drop = sorted((live[i], live[j]), key=lambda p: (not p.names, -p.size, p.id))
        out.append((drop.id, keep.id, round(-score, 3)))
        keep.absorb(drop)
        del live[drop.id]
        for other in list(live.values()):
            if other is not keep:
                offer(keep, other)
    return out


def auto_identity(crops: DataFrame, people: DataFrame, seen: DataFrame, apart: DataFrame, level: str = "balanced", floors: tuple[float, float, float] | None = None) -> DataFrame:
    """(component, step, source, target, score): the merges of people that automatic identity would make.

    ``crops`` (person_id, face_id, media_id, timestamp, cx, cy, size, embedding, quality)
    are usable faces, ``people`` (id, name, face_count), ``seen`` (person_id, media_id,
    timestamp) every live face, ``apart`` (a, b) pairs that a user keeps apart.  The best
    crops of a person count, one a track.  A merged person's best pair is the best pair of
    its parts, so components over best pairs near the floor are closed under merging, and
    each is merged by itself.
    """
    floors = floors or LEVELS[level]
    best = windows.top_n(crops, ["person_id"], [F.desc("quality"), F.asc("face_id")], 2 * CROPS)
    best = graph.cut(best.withColumn("embedding", vectors.unit(F.col("embedding"))))
    pairs = ann.similarity_join(best, floors[0] - SPLIT_BONUS - 1e-9, key="face_id")
    who = best.select("face_id", "person_id")
    side = lambda c: who.select(F.col("face_id").alias(c), F.col("person_id").alias(f"p{c}"))
    label = graph.components(pairs.join(side("a"), "a").join(side("b"), "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    label = label.select(F.col("id").alias("person_id"), "component")
    at = F.struct(F.col("media_id").cast("long").alias("m"), F.coalesce(F.round("timestamp", 3), F.lit(-1.0)).alias("t"))
    places = seen.join(label, "person_id").groupBy("person_id").agg(F.collect_set(at).alias("seen"))
    both = apart.select("a", "b").union(apart.select("b", "a"))
    kept = both.groupBy(F.col("a").alias("person_id")).agg(F.collect_set("b").alias("apart"))
    about = people.select(F.col("id").alias("person_id"), "name", F.col("face_count").alias("faces"))
    # what is known of a person goes with one crop, not with each
    one = best.groupBy("person_id").agg(F.min("face_id").alias("face_id"))
    known = one.join(places, "person_id", "left").join(kept, "person_id", "left")
    rows = best.join(label, "person_id").join(about, "person_id").join(known, ["person_id", "face_id"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    rows = rows.select("component", "person_id", "face_id", "media_id", "timestamp", "cx", "cy", "size", "embedding", "quality", "name", "faces", none("apart", "array<bigint>"), none("seen", "array<struct<m:bigint,t:double>>"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["seen"] = pdf["seen"].map(lambda s: [(x["m"], x["t"]) if isinstance(x, dict) else tuple(x) for x in s])
        found = merge_best_first([Person(g) for _, g in pdf.groupby("person_id", sort=True)], floors)
        return pd.DataFrame([(pdf["component"].iloc[0], k + 1, *x) for k, x in enumerate(found)], columns=["component", "step", "source", "target", "score"])

    return rows.groupBy("component").applyInPandas(run, "component long, step long, source long, target long, score double")


def impostor_floors(crops: DataFrame, seen: DataFrame, level: str = "balanced", least: int = 8) -> tuple[float, float, float]:
    """Floors of automatic merging raised over what people seen in one frame reach: they are known to differ.

    The 99th percentile of their best pair, best three and centres, and a little more, up to 0.78.
    """
    base = LEVELS[level]
    key = F.struct("media_id", F.coalesce(F.round("timestamp", 3), F.lit(-1.0)))
    rows = seen.select("person_id", key.alias("k")).distinct()
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.k = b.k and a.person_id < b.person_id")).select(F.col("a.person_id").alias("a"), F.col("b.person_id").alias("b")).distinct()
    best = windows.top_n(crops, ["person_id"], [F.desc("quality"), F.asc("face_id")], CROPS).withColumn("v", vectors.unit(F.col("embedding")))
    mean = vectors.centroids(best, "person_id", column="v", digits=12).select("person_id", F.col("centroid"))
    side = lambda c: best.select(F.col("person_id").alias(c), F.col("v").alias(f"v{c}"))
    cross = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", vectors.dot(F.col("va"), F.col("vb")).alias("s"))
    top = cross.groupBy("a", "b").agg(F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 3).alias("s"))  # at most CROPS squared a pair
    centre = lambda c: mean.select(F.col("person_id").alias(c), F.col("centroid").alias(f"c{c}"))
    top = top.join(centre("a"), "a").join(centre("b"), "b")
    three = F.aggregate("s", F.lit(0.0), lambda x, y: x + y) / F.size("s")
    found = top.select(F.get("s", F.lit(0)).alias("best"), three.alias("three"), vectors.dot(F.col("ca"), F.col("cb")).alias("centre"))
    row = found.agg(F.count(F.lit(1)).alias("n"), *(F.percentile(c, 0.99).alias(c) for c in ("best", "three", "centre"))).first()
    if row["n"] < least:
        return base
    return tuple(min(0.78, max(b, row[c] + 0.02)) for b, c in zip(base, ("best", "three", "centre"), strict=True))


def video_moments(frames: DataFrame, query: list[float], people: DataFrame | None = None, limit: int = 40, per_video: int = 3, depth: int = 2000) -> DataFrame:
    """(id, media_id, t, similarity): keyframes (id, media_id, t, embedding) most like a query, few of one video, of given people's videos only."""
    rows = frames if people is None else frames.join(people.select("media_id").distinct(), "media_id", "left_semi")
    near = vectors.nearest(rows, query, depth, key="id")
    near = windows.top_n(near, ["media_id"], [F.desc("similarity"), F.asc("id")], per_video)
    return near.orderBy(F.desc("similarity"), "id").limit(limit).select("id", "media_id", F.round("t", 2).alias("t"), F.round("similarity", 4).alias("similarity"))


def best_similarity(signals: DataFrame) -> DataFrame:
    """(id, similarity): the best similarity of an item over ranked signals (signal, id, similarity), recency aside."""
    return signals.where("signal <> 'recency'").groupBy("id").agg(F.max("similarity").alias("similarity"))


def expansions(phrases: list[str], weight: float = 0.5, most: int = 4) -> dict[str, float]:
    """Weights of the extra text signals that rewritten phrases make."""
    kept = [p.strip() for p in phrases if p and p.strip()][:most]
    return {f"expansion_{i}": weight for i in range(len(kept))}

