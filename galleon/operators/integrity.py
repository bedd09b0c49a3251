"""Integrity of stored vectors and links, and which vector space serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows of the child whose parent is gone; a null key has none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def checksum_problems(vectors: DataFrame, sample: float = 1.0) -> DataFrame:
    """(key, problem) of vectors (key, embedding, sha256, dim) over a repeatable share of the keys."""
    rows = vectors.where(F.pmod(F.xxhash64("key"), F.lit(10_000)) < int(sample * 10_000))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    problem = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != F.col("dim"), "size").when(bad, "not finite").when(F.sha2(F.to_json("embedding"), 256) != F.col("sha256"), "checksum")
    return rows.select("key", problem.alias("problem")).where("problem is not null")


def estimate(problems: int, checked: int, total: int) -> int:
    """Problems among all, from a sample."""
    return round(problems * total / checked) if checked else 0


def torn_tail(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records (file, offset, length) that reach past the end of their file (file, bytes)."""
    return records.join(sizes, "file", "left").where(F.col("bytes").isNull() | (F.col("offset") + F.col("length") > F.col("bytes")))


def coverage(media: DataFrame, vectors: DataFrame) -> DataFrame:
    """(model_key, filled, total, coverage) of every model over the live media."""
    live = media.where("deleted_at is null and missing = 0").select("id")
    total = live.agg(F.count(F.lit(1))).scalar()
    g = vectors.join(live, vectors.media_id == live.id, "left_semi").groupBy("model_key").agg(F.count_distinct("media_id").alias("filled"))
    return g.select("model_key", "filled", total.alias("total"), (F.col("filled") / total).alias("coverage"))


def active_space(models: DataFrame, covered: DataFrame, enough: float = 0.95) -> DataFrame:
    """(role, model_key) that serves each role: pinned, else the newest covered enough, else the best covered.

    ``models`` are (model_key, role, created, pinned, plugin); models of plugins serve only when pinned.
    """
    rows = models.join(covered.select("model_key", "coverage"), "model_key", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    rows = rows.where("pinned or not plugin")
    good = (F.col("coverage") >= enough).cast("int")
    order = F.struct(F.col("pinned").cast("int"), good, F.when(good == 1, F.col("created")), "coverage", "model_key")
    return rows.groupBy("role").agg(F.max_by("model_key", order).alias("model_key"))


def overlap(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: sizes of two result lists and of what they share."""
    both = a.select(key, F.lit(1).alias("a")).join(b.select(key, F.lit(1).alias("b")), key, "full")
    return both.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def transitions(status: DataFrame, by: str, ts: str, state: str) -> DataFrame:
    """Rows at which a state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(ts))
    return status.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(state))).drop("_before")
