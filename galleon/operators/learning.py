"""Calibration: threshold tuning and a gated logistic model of match feedback."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Cells of similarity between 0 and 1.
CELLS = 1000


def sweep(pairs: DataFrame, low: float = 0.3, high: float = 0.8, beta: float = 0.5) -> DataFrame:
    """(t, precision, recall, f, tp) at every distinct similarity within the range; equal similarities count together."""
    by = pairs.groupBy(F.col("similarity").alias("t")).agg(F.sum("correct").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("t") * CELLS))
    # running sums over cells of similarity, then within each cell: no window holds all rows
    cells = by.groupBy("cell").agg(F.sum("pos").alias("p"), F.sum("n").alias("c"))
    before = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * CELLS + 1 rows
    cells = cells.select("cell", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))
    w = Window.partitionBy("cell").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    by = by.join(F.broadcast(cells), "cell").select("t", (F.col("p") + F.sum("pos").over(w)).alias("tp"), (F.col("c") + F.sum("n").over(w)).alias("said"))
    total = pairs.agg(F.sum("correct")).scalar()
    c = by
    p, r, b = F.col("tp") / F.col("said"), F.col("tp") / total, beta * beta
    f = F.when(F.col("tp") > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)
    return c.where(F.col("t").between(low, high)).select("t", p.alias("precision"), r.alias("recall"), f.alias("f"), "tp")


def tune(pairs: DataFrame, current: float, least: int = 40, each: int = 10, rate: float = 0.25, low: float = 0.3, high: float = 0.8) -> float:
    """The threshold moved towards the best one; unchanged with too little feedback."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("pos")).first()
    pos = n["pos"] or 0
    if n["n"] < least or min(pos, n["n"] - pos) < each:
        return current
    best = sweep(pairs, low, high).orderBy(F.desc("f"), F.desc("precision"), F.asc("t")).first()
    return current if best is None else round(min(high, max(low, current + rate * (best["t"] - current))), 3)


class Fit(NamedTuple):
    """A fitted model and whether its held-out precision and recall allow it to act."""

    coefficients: list[float]
    intercept: float
    precision: float
    recall: float
    active: bool


def train(feedback: DataFrame, group: str = "media_id", features: tuple[str, ...] = ("similarity", "quality", "detection"), holdout: float = 0.3, cut: float = 0.9) -> Fit | None:
    """Logistic regression on feedback (features, correct, group), judged on held-out groups by hash.

    Null with fewer than 20 rows of either class on the training side or 10 on the other.
    """
    side = (F.pmod(F.xxhash64(group), F.lit(1000)) < int(holdout * 1000)).cast("int")
    rows = VectorAssembler(inputCols=list(features), outputCol="x").transform(feedback.withColumn("held", side).withColumn("y", F.col("correct").cast("double")))
    seen = {(r.held, r.correct): r["count"] for r in feedback.withColumn("held", side).groupBy("held", "correct").count().collect()}
    if min(seen.get((0, c), 0) for c in (0, 1)) < 20 or min(seen.get((1, c), 0) for c in (0, 1)) < 10:
        return None
    n = seen[(0, 0)] + seen[(0, 1)]
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (10 * n), standardization=False).fit(rows.where("held = 0"))
    said = model.transform(rows.where("held = 1")).withColumn("p", (F.get(vector_to_array("probability"), F.lit(1)) >= cut).cast("int"))
    t = said.agg(F.sum("p").alias("said"), F.sum(F.col("p") * F.col("correct")).alias("tp"), F.sum("correct").alias("all"), F.avg("correct").alias("base")).first()
    precision = t["tp"] / t["said"] if t["said"] else 1.0
    recall = t["tp"] / t["all"]
    return Fit(list(map(float, model.coefficients)), float(model.intercept), precision, recall, bool(precision >= 0.95 and recall >= 0.5 and t["tp"] >= 10 and precision >= t["base"]))
