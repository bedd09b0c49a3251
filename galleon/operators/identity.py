"""Identities: assignment to fixed centroids, reconciliation, merge suggestions, merge plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ann, graph, meetings, vectors, windows


def assign(faces: DataFrame, people: DataFrame, threshold: float, margin: float = 0.04, block_rows: int = 4096) -> DataFrame:
    """(face_id, person_id, similarity): the nearest centroid at or above the threshold, unless a second is within ``margin``.

    Faces (face_id, embedding) against people (person_id, centroid), as block products.
    """
    both = faces.select((F.col("face_id") * 2).alias("vec_id"), "embedding").unionByName(people.select((F.col("person_id") * 2 + 1).alias("vec_id"), F.col("centroid").alias("embedding")))
    top = vectors.top_k_join(both.where("vec_id % 2 = 0"), both.where("vec_id % 2 = 1"), 2, block_rows=block_rows)
    g = top.groupBy("a").agg(F.max(F.when(F.col("rank") == 1, F.struct("similarity", "b"))).alias("x"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    ok = (F.col("x.similarity") >= threshold) & (F.col("second").isNull() | (F.col("x.similarity") - F.col("second") >= margin))
    return g.select((F.col("a") / 2).cast("long").alias("face_id"), F.when(ok, ((F.col("x.b") - 1) / 2).cast("long")).alias("person_id"), F.col("x.similarity").alias("similarity"))


def reconcile(vecs: DataFrame, threshold: float, key: str = "vec_id") -> DataFrame:
    """(id, group), before corrections (``reconcile.reconcile`` keeps them): density groups of two or more (every neighbour counts), i.e. components over close pairs; others have null."""
    label = graph.components(ann.similarity_join(vecs, threshold - 1e-6, key=key))
    return vecs.select(F.col(key).alias("id")).join(label, "id", "left").select("id", F.col("component").alias("group"))


def merge_suggestions(crops: DataFrame, centroid_floor: float, crop_floor: float, apart: DataFrame | None = None, limit: int = 60, per_person: int = 8) -> DataFrame:
    """(a, b, centroid, best, score) of people that look alike: best crops and centroids, pairs kept apart excluded.

    ``crops`` are (person_id, face_id, embedding, quality); the best ``per_person`` of each count.
    """
    best = windows.top_n(crops, ["person_id"], [F.desc("quality"), F.asc("face_id")], per_person)
    who = best.select(F.col("face_id").alias("f"), F.col("person_id").alias("p"))
    pairs = ann.similarity_join(best, crop_floor - 0.2, key="face_id")
    pairs = pairs.join(who.select(F.col("f").alias("a"), F.col("p").alias("pa")), "a").join(who.select(F.col("f").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
    near = pairs.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.max("similarity").alias("best"))
    mean = vectors.centroids(best, "person_id", F.greatest(F.lit(0.15), F.col("quality")), digits=9).select("person_id", "centroid")
    side = lambda c: mean.select(F.col("person_id").alias(c), F.col("centroid").alias(f"c{c}"))
    rows = near.join(side("a"), "a").join(side("b"), "b").withColumn("centroid", vectors.dot(F.col("ca"), F.col("cb")))
    rows = rows.where((F.col("centroid") >= centroid_floor) & (F.col("best") >= crop_floor - 0.2) | (F.col("best") >= crop_floor))
    if apart is not None:
        rows = rows.join(apart.select("a", "b"), ["a", "b"], "left_anti")
    rows = rows.withColumn("score", 0.6 * F.col("best") + 0.4 * F.col("centroid"))
    return rows.orderBy(F.desc("score"), "a", "b").limit(limit).select("a", "b", "centroid", "best", "score")


def merge_plan(pairs: list[tuple[int, int]], named: set[int], limit: int) -> list[tuple[int, int]]:
    """(source, target) of disjoint merges, best pairs first: two named people never merge, a named one stays."""
    used: set[int] = set()
    plan: list[tuple[int, int]] = []
    for a, b in pairs:
        if len(plan) >= limit:
            break
        if a in used or b in used or (a in named and b in named):
            continue
        plan.append((a, b) if b in named else (b, a))
        used |= {a, b}
    return plan


def collisions(faces: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(a, b): people seen at one time in one item, so never the same; a missing time meets every time."""
    l = faces.where("person_id is not null").select("media_id", F.col("person_id").alias("a"), F.col("timestamp").alias("ta"))  # noqa: E741
    r = l.select("media_id", F.col("a").alias("b"), F.col("ta").alias("tb"))
    ok = F.col("ta").isNull() | F.col("tb").isNull() | (F.abs(F.col("ta") - F.col("tb")) <= tolerance)
    return l.join(r, "media_id").where((F.col("a") < F.col("b")) & ok).select("a", "b").distinct()


def tracker_splits(faces: DataFrame, seconds: float = 12.0, sizes: float = 0.6) -> DataFrame:
    """(a, b): people seen in one video within seconds and at nearly one place, as if tracking had lost them between.

    Faces are (person_id, media_id, timestamp, cx, cy, size).  The larger of two faces sets how far they may be apart.
    """
    rows = faces.select("person_id", "media_id", "timestamp", "cx", "cy", (sizes * F.coalesce("size", F.lit(-1.0)).cast("double")).alias("r"))
    kind = dict(faces.dtypes)["person_id"]
    return meetings.meetings(rows, seconds).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
