"""Incremental tables: scan diffs, change journals, audit state, merges, albums, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows


def scan_diff(known: DataFrame, files: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(key, change): new, changed, gone or same, comparing the ``same`` columns null-safely."""
    k = known.select(key, F.lit(True).alias("in_known"), *(F.col(c).alias(f"k_{c}") for c in same))
    f = files.select(key, F.lit(True).alias("in_files"), *same)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    change = F.when(F.col("in_known").isNull(), "new").when(F.col("in_files").isNull(), "gone").when(equal, "same").otherwise("changed")
    return k.join(f, key, "full").select(key, change.alias("change"))


def strike(missing: Column, strikes: Column, network: bool) -> Column:
    """Strikes after a scan: local folders at once, network shares after two absences."""
    return F.when(missing, F.least(strikes + (1 if network else 2), F.lit(2))).otherwise(0)


def apply_changes(base: DataFrame, journal: DataFrame, key: str, seq: str, deleted: Column) -> DataFrame:
    """The base with the last change of every key applied; deletions remove."""
    last = windows.best(journal, [key], [F.col(seq)])
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(~deleted).select(*base.columns))


def audit_state(log: DataFrame, entity: str, seq: str, action: str) -> DataFrame:
    """(entity, action, entries): the last action of every entity."""
    return log.groupBy(entity).agg(F.max_by(action, seq).alias("action"), F.count(F.lit(1)).alias("entries"))


def merge(mine: DataFrame, theirs: DataFrame, key: str, policy: str) -> DataFrame:
    """(key, value, origin) of two keyed tables under keep_both, skip or overwrite."""
    a = mine.select(key, F.col("value").alias("a"))
    b = theirs.select(key, F.col("value").alias("b"))
    j = a.join(b, key, "full")
    if policy == "keep_both":
        rows = j.select(key, F.explode(F.filter(F.array(F.struct(F.col("a").alias("value"), F.lit("mine").alias("origin")), F.struct(F.col("b").alias("value"), F.lit("theirs").alias("origin"))), lambda x: x["value"].isNotNull())).alias("r"))
        return rows.select(key, "r.value", "r.origin")
    first, second, names = (("a", "b", ("mine", "theirs")) if policy == "skip" else ("b", "a", ("theirs", "mine")))
    return j.select(key, F.coalesce(first, second).alias("value"), F.when(F.col(first).isNotNull(), names[0]).otherwise(names[1]).alias("origin"))


def remap(links: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Rewrites merged ids (old, new) in a relation; rows that become equal are kept once."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    out = links.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    return out.select(*links.columns).dropDuplicates()


def append_to_album(album: DataFrame, items: DataFrame) -> DataFrame:
    """album (album_id, media_id, position) with the new (album_id, media_id, ord) after its end; present ones stay."""
    fresh = items.join(album, ["album_id", "media_id"], "left_anti").groupBy("album_id", "media_id").agg(F.min("ord").alias("ord"))
    top = album.groupBy("album_id").agg(F.max("position").alias("top"))
    ranked = windows.top_n(fresh, ["album_id"], [F.asc("ord"), F.asc("media_id")], 2**31 - 1, "i")
    ranked = ranked.join(top, "album_id", "left").select("album_id", "media_id", (F.coalesce("top", F.lit(0)) + F.col("i")).cast("long").alias("position"))
    return album.select("album_id", "media_id", "position").unionByName(ranked)


def queue_merge(queue: DataFrame) -> DataFrame:
    """Queued work with one key merged: distinct paths in order, the least priority, how many."""
    return queue.groupBy("dedupe_key").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda x: x["path"])).alias("paths"), F.min("priority").alias("priority"), F.count(F.lit(1)).alias("merged"))


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs after a crash: running ones queue again, failed at the third attempt."""
    again = F.col("status") == "running"
    attempts = F.col("attempts") + again.cast("int")
    status = F.when(again & (attempts >= 3), "failed").when(again, "queued").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "attempts": attempts})
