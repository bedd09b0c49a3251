"""Ranking, top-k, sampling and gaps-and-islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PART_ROWS = 250_000  # rows that a task of a dealt table joins, about


def parts(rows: DataFrame, each: int = PART_ROWS) -> int:
    """Into how many parts to deal a table so that none has more than ``each`` rows, about; no fewer than tasks run at once.

    Shuffles are merged by their bytes, and narrow columns compress so well that a task may get millions of
    rows to sort.  Parts by number of rows bound that, however large the table is.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def top_n(df: DataFrame, by: list, order: list[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` should end in a unique key."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)
    return out if name else out.drop(rank)


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The best row of each group by map-side combined ``max_by``: no sort of a hot group.

    ``order`` are columns to maximise, ties broken by the last one.
    """
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def two_level_sample(df: DataFrame, outer: str, inner: list, order: list[Column], n: int) -> DataFrame:
    """Best of each inner group, then the best ``n`` of each outer one."""
    return top_n(top_n(df, [outer, *inner], order), [outer], order, n, "sample_rank")


def islands(df: DataFrame, by: list[str], order: list[str], linked: Column, name: str = "island") -> DataFrame:
    """Numbers chains of rows; ``linked`` says whether a row joins the one before (``prev.*`` via lag)."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def previous(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def pseudo_random(df: DataFrame, key: str, n: int) -> DataFrame:
    """A repeatable sample, by a multiplicative order of the key."""
    return df.orderBy(F.pmod(F.col(key) * 7919, F.lit(1009)), key).limit(n)
