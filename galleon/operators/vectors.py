"""Vectors: norms, exact nearest neighbours, blocked similarity joins, centroids, evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import top_n


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length one; null where it is not finite or has no length."""
    ok = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & (norm(a) >= 1e-12)
    return F.when(ok, F.transform(a, lambda x: x.cast("double") / norm(a)))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact top ``k`` by cosine to a literal query; filters on ``vectors`` apply before scoring."""
    q = F.array(*map(F.lit, map(float, query)))
    sim = vectors.withColumn("similarity", cosine(F.col(column), q))
    return sim.orderBy(F.desc("similarity"), key).limit(k)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as unit rows, from its flat values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    v = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _blocks(vectors: DataFrame, key: str, column: str, n: int) -> DataFrame:
    return vectors.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("block"), F.col(key).alias("id"), F.col(column).alias("v"))


def similarity_join(vectors: DataFrame, threshold: float, key: str = "vec_id", column: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """Pairs (a < b, similarity) with cosine at or above the threshold.

    Vectors are dealt to blocks; each pair of blocks meets once in a matrix product, so
    a task holds two blocks and emits only pairs over the threshold.
    """
    count = vectors.count()
    n = max(1, -(-count // block_rows))
    rows = _blocks(vectors, key, column, n)
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lo, hi = F.least("block", F.col("other").cast("long")), F.greatest("block", F.col("other").cast("long"))
    pairs = pairs.select(lo.alias("lo"), hi.alias("hi"), "block", "id", "v")

    def run(t: pa.Table) -> pa.Table:
        side = t["block"].to_numpy()
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        ids = t["id"].to_numpy()
        v = matrix(t["v"])
        x, y = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        sim = v[x] @ v[y].T
        i, j = np.nonzero(sim >= threshold)
        a, b, s = ids[x[i]], ids[y[j]], sim[i, j]
        ok = a < b if lo == hi else np.ones(len(a), bool)
        return pa.table({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "similarity": s[ok]})

    return pairs.groupBy("lo", "hi").applyInArrow(run, "a long, b long, similarity double")


TOP_ROWS = 1024  # queries of a block that are compared at once


def _top(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest of every row, best first, ties by column; no row is sorted whole."""
    n = sim.shape[1]
    if k < 1 or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(sim, n - min(k, n), axis=1)[:, n - min(k, n)]
    i, j = np.nonzero(sim >= least[:, None])
    order = np.lexsort((j, -sim[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def top_k_join(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """For each query vector the ``k`` nearest others: block products, then a merge of block winners."""
    n = max(1, -(-vectors.count() // block_rows))
    m = max(1, -(-queries.count() // block_rows))
    left = _blocks(queries, key, column, m).select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("d"), F.lit(0).alias("side"), "id", "v")
    right = _blocks(vectors, key, column, n).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("q"), F.col("block").cast("int").alias("d"), F.lit(1).alias("side"), "id", "v")

    def run(t: pa.Table) -> pa.Table:
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        v = matrix(t["v"])
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y = y[np.argsort(ids[y], kind="stable")]  # ties go to the least id
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for part in np.array_split(x, -(-len(x) // TOP_ROWS)) if len(x) and len(y) else []:
            sim = v[part] @ v[y].T
            sim[ids[part][:, None] == ids[y][None, :]] = -np.inf
            i, j = _top(sim, k)
            a.append(ids[part[i]])
            b.append(ids[y[j]])
            s.append(sim[i, j])
        a, b, s = map(np.concatenate, (a, b, s))
        ok = np.isfinite(s)
        return pa.table({"a": a[ok], "b": b[ok], "similarity": s[ok]})

    best = left.union(right).groupBy("q", "d").applyInArrow(run, "a long, b long, similarity double")
    return top_n(best, ["a"], [F.desc("similarity"), F.asc("b")], k, "rank")


def centroids(vectors: DataFrame, by: str, weight: Column | None = None, column: str = "embedding", digits: int = 6) -> DataFrame:
    """(by, members, centroid at unit length, variance): sums by (group, dimension) combine map-side."""
    w = weight if weight is not None else F.lit(1.0)
    cells = vectors.select(by, w.alias("w"), F.posexplode(column).alias("pos", "x"))
    sums = cells.groupBy(by, "pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("wx"), F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    rows = sums.groupBy(by).agg(F.max("n").alias("members"), F.array_sort(F.collect_list(F.struct("pos", "wx", "x"))).alias("s"))  # one entry a dimension
    total = F.transform("s", lambda c: c["wx"])
    plain = F.transform("s", lambda c: c["x"])
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, c: a + c["wx"] * c["wx"]))
    rows = rows.select(by, "members", F.transform(total, lambda x: x / length).alias("centroid"), plain.alias("plain"))
    variance = F.greatest(F.lit(0.0), 1 - dot(F.col("centroid"), F.col("plain")) / F.col("members"))
    return rows.select(by, "members", F.transform("centroid", lambda x: F.round(x, digits)).alias("centroid"), F.round(variance, digits).alias("variance"))


def rrf(signals: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of rows (signal, id, rank): id, score, n_signals.

    Signals without a positive weight are dropped; ranks count from 1.
    """
    w = F.coalesce(*(F.when(F.col("signal") == s, F.lit(float(x))) for s, x in weights.items()), F.lit(0.0))
    rows = signals.withColumn("w", w).where("w > 0")
    return rows.groupBy("id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("n_signals"))


def leave_one_out(vectors: DataFrame, label: str, threshold: float, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, own and best wrong similarity to label centroids, and the outcome; sums, not pairs."""
    cells = vectors.select(key, label, F.posexplode(column).alias("pos", "x"))
    sums = cells.groupBy(label, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = sums.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("c")).select(F.col(label).alias("other"), F.transform("c", lambda x: x["s"]).alias("s"))
    if sums.count() > 10_000:
        raise ValueError("too many labels for one table of centroids")
    every = sums.agg(F.array_sort(F.collect_list(F.struct("other", "s"))).alias("all")).scalar()  # one entry a label
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.select(key, label, F.explode(every).alias("c"), v.alias("v"))
    s = F.when(F.col("c.other") == F.col(label), F.zip_with("c.s", "v", lambda a, b: a - b)).otherwise(F.col("c.s"))
    rows = rows.withColumn("sim", dot(s, F.col("v")) / norm(s))
    own = F.max(F.when(F.col("c.other") == F.col(label), F.col("sim")))
    wrong = F.max(F.when(F.col("c.other") != F.col(label), F.col("sim")))
    rows = rows.groupBy(key, label).agg(own.alias("own"), wrong.alias("wrong"))
    return rows.select(key, F.round("own", 6).alias("own"), F.round("wrong", 6).alias("wrong"), F.when((F.col("own") >= threshold) & (F.col("wrong") < threshold), "tp").when(F.col("wrong") >= threshold, "fp").otherwise("fn").alias("outcome"))

