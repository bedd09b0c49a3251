"""User functions: embedders, classifiers, search signals and export plans, as vectorised UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

API = (1, 0)
MAX_LABELS, MAX_LABEL, MAX_PATHS, MAX_CANDIDATES = 20, 60, 10, 300


def compatible(wanted: str) -> bool:
    """Whether an API version (major.minor) is served: equal major, minor not newer."""
    major, _, minor = wanted.partition(".")
    return int(major) == API[0] and int(minor or 0) <= API[1]


def embedder(embed: Callable[[list[bytes]], list], dim: int) -> Callable[[Column], Column]:
    """A column function binary -> struct(vec, error): a batch that fails is retried row by row."""
    if not 2 <= dim <= 4096:
        raise ValueError("dimension out of range")

    def one(content: bytes | None) -> tuple[list[float] | None, str | None]:
        if content is None:
            return None, "no content"
        try:
            v = np.asarray(embed([content])[0], float)
        except Exception as e:  # the row keeps its error
            return None, f"{type(e).__name__}: {e}"
        if v.shape != (dim,) or not np.isfinite(v).all() or np.linalg.norm(v) < 1e-12:
            return None, "not a finite vector of the declared dimension"
        return (v / np.linalg.norm(v)).tolist(), None

    @F.pandas_udf("vec array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [one(x) for x in s]
            yield pd.DataFrame({"vec": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return run


def classifier(classify: Callable[[list[bytes]], list[list[dict]]]) -> Callable[[Column], Column]:
    """A column function binary -> array(struct(label, score)): lower-cased short labels, scores within 0..1, best first."""

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found = classify([bytes(x) for x in s])
            out = []
            for labels in found:
                best: dict[str, float] = {}
                for x in labels:
                    score, label = float(x["score"]), str(x["label"]).strip().lower()[:MAX_LABEL]
                    if label and math.isfinite(score):
                        best[label] = max(best.get(label, 0.0), min(1.0, max(0.0, score)))
                out.append([{"label": k, "score": v} for k, v in sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:MAX_LABELS]])
            yield pd.Series(out)

    return run


def signal(candidates: DataFrame, rank: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """(id, value) of the best candidates (id, score, columns) as scored by a user function; a bounded top list."""
    top = candidates.orderBy(F.desc("score"), F.desc("id")).limit(MAX_CANDIDATES)

    @F.pandas_udf("double")
    def score(df: pd.DataFrame) -> pd.Series:
        return rank(df)

    return top.select("id", score(F.struct(*columns)).alias("value")).where("value is not null and not isnan(value)")


def export_plan(items: DataFrame, plan: Callable[[dict], list[str]], key: str = "id") -> DataFrame:
    """(key, path): at most ten relative paths an item, never above the target folder."""

    @F.pandas_udf("array<string>")
    def run(df: pd.DataFrame) -> pd.Series:
        return pd.Series([list(plan(r))[:MAX_PATHS] for r in df.to_dict("records")])

    rows = items.select(key, F.explode(run(F.struct(*items.columns))).alias("path"))
    return rows.where(~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$)|^[A-Za-z]:)"))
