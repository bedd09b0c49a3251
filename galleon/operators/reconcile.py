"""Automatic people that look alike become one, as far as corrections allow.

People whose centres are close form groups (components over close pairs; alone is nobody's
neighbour).  Within a group everyone is tried against the one of least id, in the order of
ids: who is still close to the centre as it has become, and was never seen together
with anyone in it, joins and moves the centre.

Groups may be of any size, so they are worked off in rounds: a round takes the next ``block`` people of
every group.  Whoever may not be together with those who joined in earlier rounds is taken out
by a join; what is left is tried in order in one task for each group, which holds
``block`` centres, when and where these people were seen, and the corrections among them.

Who was seen together is never listed in pairs: people of a group have not met, so at one place and time there is
at most one of them, and whoever is tried looks only there.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import ann, graph
from .windows import top_n

LEAST_WEIGHT = 0.15
TOLERANCE = 0.001  # seconds between faces seen at one time
STEP = 1024  # people tried against one centre at once
OUT = "kind string, group long, person_id long, sum array<double>, joined boolean"


def sums(faces: DataFrame) -> DataFrame:
    """(person_id, n, sum): looks weighted by quality and added up; partial sums come first."""
    rows = faces.where("person_id is not null").select("person_id", F.greatest(F.lit(LEAST_WEIGHT), F.coalesce("quality", F.lit(0.0))).alias("w"), F.posexplode("vec").alias("pos", "x"))
    each = rows.groupBy("person_id", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.count(F.lit(1)).alias("n"))
    found = each.groupBy("person_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s"))  # as many as a look has numbers
    return found.select("person_id", "n", F.transform("s", lambda s: s["x"]).alias("sum"))


class _Sights:
    """Where and when people of a group were seen."""

    def __init__(self):
        self.times: dict[int, list[float]] = {}
        self.untimed: set[int] = set()

    def meets(self, sights: list[tuple[int, float | None]]) -> bool:
        for media, t in sights:
            if media in self.untimed or (t is None and media in self.times):
                return True
            if t is not None and media in self.times:
                there = self.times[media]
                at = bisect_left(there, t)
                if any(abs(t - x) <= TOLERANCE for x in there[max(0, at - 1) : at + 1]):
                    return True
        return False

    def add(self, sights: list[tuple[int, float | None]]) -> None:
        for media, t in sights:
            there = self.times.setdefault(media, [])
            if t is None:
                self.untimed.add(media)
            elif np.isfinite(t):  # no others are at no time at all
                insort(there, t)


def _try(threshold: float):
    def run(rows: pa.Table, more: pa.Table) -> pa.Table:
        rows = rows.sort_by([("first", "descending"), ("person_id", "ascending")])  # the group so far, then who is next
        ids, head = rows["person_id"].to_pylist(), rows["first"][0].as_py() == 1
        flat = rows["sum"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        vecs = flat.reshape(len(ids), -1)
        apart: dict[int, set[int]] = {}
        sights: dict[int, list[tuple[int, float | None]]] = {}
        for a, b, media, t in zip(*(more[c].to_pylist() for c in ("a", "b", "media_id", "timestamp")), strict=True):
            if b is not None:
                apart.setdefault(a, set()).add(b)
                apart.setdefault(b, set()).add(a)
            else:
                sights.setdefault(a, []).append((media, t))
        total, members, seen = vecs[0].copy(), {ids[0]}, _Sights()
        joined = [] if head else [ids[0]]  # nobody yet: the least id is the group
        if not head:
            seen.add(sights.get(ids[0], []))
        norms = np.linalg.norm(vecs, axis=1)
        for start in range(1, len(ids), STEP):
            end, at = min(start + STEP, len(ids)), start
            while at < end:  # whoever is close to the centre as it is, until it moves
                close = at + np.flatnonzero((norms[at:end] > 0) & (vecs[at:end] @ total >= (threshold - 1e-9) * np.linalg.norm(total) * norms[at:end]))
                at = end
                for i in close.tolist():
                    norm, person = np.linalg.norm(total) * np.linalg.norm(vecs[i]), ids[i]
                    if norm > 0 and float(total @ vecs[i]) / norm >= threshold and not apart.get(person, set()) & members and not seen.meets(sights.get(person, [])):
                        total += vecs[i]
                        members.add(person)
                        seen.add(sights.get(person, []))
                        joined.append(person)
                        at = i + 1
                        break
        out = [("person", p, None, True) for p in joined] + [("group", ids[0], total.tolist(), None)]
        kinds = {"kind": pa.string(), "sum": pa.list_(pa.float64()), "joined": pa.bool_()}
        found = {c: pa.array([r[i] for r in out], kinds.get(c, pa.int64())) for i, c in enumerate(("kind", "person_id", "sum", "joined"))}
        return pa.table({"group": pa.array([rows["group"][0].as_py()] * len(out), pa.int64())} | found).select(["kind", "group", "person_id", "sum", "joined"])

    return run


def _met(some: DataFrame, joined: DataFrame) -> DataFrame:
    """(group, person_id) of ``some`` sights (group, person_id, media_id, timestamp) that are those of ``joined`` ones.

    Times meet in slots of two tolerances and their neighbours; as the joined have not met, few are in one slot.
    """
    slot = F.rint(F.col("timestamp") / (2 * TOLERANCE))
    place = joined.select("group", "media_id", F.col("timestamp").alias("_t"), F.explode(F.array(*(F.rint(F.col("timestamp") / (2 * TOLERANCE)) + i for i in (-1, 0, 1)))).alias("_slot"))
    timed = some.where("timestamp is not null").withColumn("_slot", slot).join(place.where("_t is not null"), ["group", "media_id", "_slot"]).where(F.abs(F.col("timestamp") - F.col("_t")) <= TOLERANCE)
    never = some.join(joined.where("timestamp is null").select("group", "media_id").distinct(), ["group", "media_id"], "left_semi")
    untimed = some.where("timestamp is null").join(joined.select("group", "media_id").distinct(), ["group", "media_id"], "left_semi")
    ids = ["group", "person_id"]
    return timed.select(*ids).union(never.select(*ids)).union(untimed.select(*ids))


def reconcile(faces: DataFrame, threshold: float, protected: DataFrame, apart: DataFrame | None = None, block: int = 16_384) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merges, noise, centres) of faces (face_id, person_id, media_id, timestamp, vec, quality).

    merges are (source, target); noise are faces (face_id, person_id) of people who look like
    nobody and have this face alone; centres are (person_id, sum, n) of everyone left, sums as in ``sums``.
    ``protected`` people (person_id) take no part.  Two people seen at one time in one item never meet, nor
    do pairs ``apart`` (a, b).
    """
    spark = faces.sparkSession
    tables = Scratch(spark)
    all_people = tables.write(sums(faces))
    people = tables.write(all_people.join(protected.select("person_id").distinct(), "person_id", "left_anti"))
    close = ann.similarity_join(people, threshold - 1e-6, key="person_id", column="sum")
    group = graph.components(close).select(F.col("id").alias("person_id"), F.col("component").alias("group"))
    todo = tables.write(people.join(group, "person_id").select("group", "person_id", "sum"))
    of = todo.select("group", "person_id")
    sights = faces.where("media_id is not null").select("person_id", "media_id", F.col("timestamp").cast("double").alias("timestamp")).distinct()
    sights = tables.write(sights.join(of, "person_id").select("group", "person_id", "media_id", "timestamp"))
    both = spark.createDataFrame([], "group long, a long, b long")
    if apart is not None:
        pair = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        both = pair.join(of.select(F.col("person_id").alias("a"), "group"), "a").join(of.select(F.col("person_id").alias("b"), "group"), ["group", "b"])
        both = tables.write(both.select("group", "a", "b").distinct())  # only pairs within a group matter
    heads = spark.createDataFrame([], "group long, person_id long, sum array<double>")
    joined, number = None, 0
    while not todo.isEmpty():
        number += 1
        some = tables.write(top_n(todo, ["group"], [F.asc("person_id")], block))
        if joined is not None:
            gone = both.join(joined.select("group", F.col("person_id").alias("a")), ["group", "a"]).select("group", F.col("b").alias("person_id"))
            gone = gone.union(both.join(joined.select("group", F.col("person_id").alias("b")), ["group", "b"]).select("group", F.col("a").alias("person_id")))
            met = _met(sights.join(some.select("group", "person_id"), ["group", "person_id"], "left_semi"), sights.join(joined, ["group", "person_id"], "left_semi"))
            kept = some.join(gone.union(met).distinct(), ["group", "person_id"], "left_anti")
        else:
            kept = some
        rows = kept.withColumn("first", F.lit(0)).unionByName(heads.join(some.select("group").distinct(), "group", "left_semi").withColumn("first", F.lit(1)))
        inside = rows.select("group", F.col("person_id").alias("a"))
        pairs = both.join(inside, ["group", "a"], "left_semi").join(inside.withColumnRenamed("a", "b"), ["group", "b"], "left_semi").select("group", "a", "b")
        own = sights.join(kept.select("group", "person_id"), ["group", "person_id"], "left_semi")
        more = own.select("group", F.col("person_id").alias("a"), F.lit(None).cast("long").alias("b"), "media_id", "timestamp")
        more = more.union(pairs.select("group", "a", "b", F.lit(None).cast("long"), F.lit(None).cast("double")))
        out = tables.write(rows.groupBy("group").cogroup(more.groupBy("group")).applyInArrow(_try(threshold), OUT))
        joined = tables.append(out.where("kind = 'person' and joined").select("group", "person_id"), "joined", str(number))
        new = out.where("kind = 'group'").select("group", "person_id", "sum")
        before, heads = heads, tables.write(heads.join(new, "group", "left_anti").select("group", "person_id", "sum").union(new))
        last = some.groupBy("group").agg(F.max("person_id").alias("last"))
        was, todo = todo, tables.write(todo.join(last, "group").where("person_id > last").select("group", "person_id", "sum"))
        for old in (some, out, was, *([before] if number > 1 else [])):
            tables.drop(old)
    if joined is None:
        joined = spark.createDataFrame([], "group long, person_id long")
    merges = joined.where("person_id <> group").select(F.col("person_id").alias("source"), F.col("group").alias("target"))
    alone = people.where("n = 1").join(group, "person_id", "left_anti").select("person_id")
    noise = faces.join(alone, "person_id", "left_semi").select("face_id", "person_id")
    owner = all_people.join(merges.withColumnRenamed("source", "person_id"), "person_id", "left").groupBy(F.coalesce("target", "person_id").alias("person_id")).agg(F.sum("n").alias("n"))
    centres = owner.join(heads.select("person_id", F.col("sum").alias("_s")), "person_id", "left").join(all_people.select("person_id", "sum"), "person_id")
    return merges, noise, centres.select("person_id", F.coalesce("_s", "sum").alias("sum"), "n")
