"""Connected components of an edge table, by minimum labels and pointer jumping.

Labels only travel through joins and map-side combined minima; every round's labels
are written to the shared folder, so lineage stays short and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cuts


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of the edges (a, b); component is the least id reached."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src != dst")
    both = _cuts.written(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = _cuts.written(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        near = both.join(label, both.dst == label.id).groupBy("src").agg(F.min("component").alias("near"))
        step = label.join(near, label.id == near.src).select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        root = label.select(F.col("id").alias("root"), F.col("component").alias("jump"))
        step = _cuts.written(step.join(root, step.new == root.root).select("id", "old", F.least("new", "jump").alias("component")))
        _cuts.drop(label)
        label = step.select("id", "component")
        if step.where("old != component").isEmpty():
            _cuts.drop(both)
            return label
