"""Full-text ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def bm25(docs: DataFrame, tokens: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents with any of the tokens: plain tokens, no stemming.

    Term counts are kept in the row, so only matching documents move.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\w']+)"), 1)
    rows = docs.select(key, words.alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    rows = rows.select(key, F.size("w").alias("len"), *(count(t).alias(f"tf{i}") for i, t in enumerate(tokens)))
    rows = graph.cut(rows)  # numbers only: the texts are split once
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(tokens)))).first()
    score = F.lit(0.0)
    for i in range(len(tokens)):
        df = stats[f"df{i}"]
        idf = F.log(1 + (F.lit(stats["n"]) - df + 0.5) / (F.lit(df) + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"])))
    hit = F.lit(False)
    for i in range(len(tokens)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return rows.where(hit).select(key, score.alias("score"))
