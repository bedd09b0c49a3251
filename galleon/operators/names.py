"""Names that mean the same: joins and groups over folded text.

``folded`` is the exact key of file names: composed (NFC), without dots and blanks at the
end (unless nothing is left), case folded.  Spark has no normal forms, so Arrow batches make it, each
distinct name once.  Where equality by the rules of Unicode collation will do, a
``collation`` such as ``UNICODE_CI`` (case) or ``UNICODE_CI_AI`` (accents too) stays in the JVM; it
also takes compatible forms for one and tells sharp s from ss, which the exact key does not.

Either way rows meet by a shuffle on the key, so a name of any frequency joins like any other key.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold(name: str) -> str:
    """The key of one name."""
    composed = unicodedata.normalize("NFC", name)
    return (composed.rstrip(". ") or composed).casefold()


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map({x: fold(x) for x in names.dropna().unique()})


def folded(name: Column, collation: str | None = None) -> Column:
    """A column that is equal for names that mean the same; null for null."""
    return F.collate(name, collation) if collation else _folded(name)


def join_by_name(left: DataFrame, right: DataFrame, on: str, to: str, how: str = "inner", collation: str | None = None) -> DataFrame:
    """``left`` joined to ``right`` where the names in ``on`` and ``to`` mean the same; nulls meet nobody."""
    a, b = (df.withColumn(f"_{side}", folded(F.col(c), collation)) for df, c, side in ((left, on, "l"), (right, to, "r")))
    return a.join(b, F.col("_l") == F.col("_r"), how).drop("_l", "_r")


def group_by_name(rows: DataFrame, name: str, collation: str | None = None) -> DataFrame:
    """(name, spellings, n): each name in its most frequent spelling (ties: the least), how many spellings it has, and rows."""
    each = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("name").alias("name")))["name"]
    return each.groupBy(folded(F.col("name"), collation).alias("_k")).agg(best.alias("name"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n")).drop("_k")
