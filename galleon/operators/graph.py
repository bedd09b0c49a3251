"""Components, duplicate groups and keep-best suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..session import shared_folder
from . import windows


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _roots(parent: DataFrame, tables: Scratch) -> DataFrame:
    """(id, root) of a forest (id, parent) whose roots are their own parents, by pointer jumping."""
    while True:
        up = parent.select(F.col("id").alias("_at"), F.col("parent").alias("_up"))
        step = tables.write(parent.join(up, F.col("parent") == F.col("_at")).select("id", "parent", F.col("_up").alias("root")))
        done = step.where("root <> parent").isEmpty()
        parent = step.select("id", F.col("root").alias("parent"))
        if done:
            return step.select("id", "root")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): least id reachable, by contraction.

    Everyone points at its least neighbour or itself, pointers are followed to their roots, and what is left
    are the distinct edges between roots, until there are none.  Whoever is nobody's follower has a lesser root beside it
    in the next round, so two rounds at least halve the ids.

    The training-data subpackage finds the same in its own way, as either part must work without the other.
    """
    spark = edges.sparkSession
    tables = Scratch(spark)
    left = tables.write(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst"))
    levels = []
    while not left.isEmpty():
        # both ways in one pass; partial minima come first
        ways = left.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("id"), F.col("src").alias("next")))))
        parent = tables.write(ways.groupBy("id").agg(F.least(F.min("next"), F.col("id")).alias("parent")))
        root = _roots(parent, tables)
        levels.append(root)
        of = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        half = left.join(of("src"), "src").where("_src <> dst").select(F.col("_src").alias("src"), "dst").distinct()
        both = half.join(of("dst"), "dst").where("src <> _dst").select(F.least("src", "_dst").alias("src"), F.greatest("src", "_dst").alias("dst")).distinct()
        was, left = left, tables.write(both)
        tables.drop(was)
    if not levels:
        return left.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    label = levels.pop()
    while levels:  # roots of a round are named by the rounds after it
        after = label.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        below = levels.pop()
        label = below.join(after, below.root == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"))
    label = Scratch(spark).write(label.select("id", F.col("root").alias("component")))
    tables.drop()
    return label


def near_groups(pairs: DataFrame) -> DataFrame:
    """Groups of the pairs (a, b, similarity): key, size and the best similarity."""
    label = components(pairs)
    best = pairs.join(label, pairs.a == label.id).groupBy("component").agg(F.max("similarity").alias("similarity"))
    size = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return size.join(best, "component").select(F.concat(F.lit("near-"), F.col("component").cast("string")).alias("key"), "size", F.round("similarity", 6).alias("similarity"))


def exact_groups(items: DataFrame, content: str, key: str, order: list) -> DataFrame:
    """Groups of two or more with equal content hash: hash, size, the item to keep, bytes saved."""
    rows = items.withColumn("hash", F.sha2(F.col(content), 256))
    g = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.max_by(key, F.struct(*order)).alias("keep"), F.sum(F.octet_length(content)).alias("total"), F.max(F.octet_length(content)).alias("one"))
    return g.where("size >= 2").select("hash", "size", "keep", (F.col("total") - F.col("one")).alias("saved"))


def one_each(items: DataFrame, by: list[str], order: list) -> DataFrame:
    return windows.best(items, by, order)
