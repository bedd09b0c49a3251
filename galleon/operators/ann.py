"""Inverted lists: approximate neighbours with a measured recall, and exact joins pruned by angles.

Centres are fitted on a bounded sample; every vector is put into the list of its nearest
centre.  A list knows the widest angle of its vectors, so by the triangle inequality of
angles a join at a threshold visits only lists that can hold a partner and loses none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, vectors
from .vectors import matrix
from .windows import top_n

SAMPLE = 20_000  # rows on which centres are fitted
LISTS = 4096  # lists at most: the centres are sent to every task
SLACK = 1e-6
VISITORS = 65_536  # rows that a task compares with its block, about
COPIES, SENT = 1_000_000, 8192  # rows that are dealt, and sent, at once


def fit_centres(v: np.ndarray, lists: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centres of unit rows by spherical k-means."""
    centres = v[np.random.default_rng(seed).permutation(len(v))[:lists]].copy()
    for _ in range(rounds):
        of = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-300), centres)
    return centres


class Index(NamedTuple):
    """Centres, and the vectors as (list, angle, id, v)."""

    centres: np.ndarray
    rows: DataFrame


def build(rows: DataFrame, lists: int | None = None, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE) -> Index:
    """An index of all rows; ``lists`` follows the square root of their number."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    n = rows.count()
    lists = max(1, min(LISTS, lists or round(n**0.5), n))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    centres = fit_centres(matrix(some["v"]), lists) if n else np.zeros((1, 1))

    def put(batches):
        for b in batches:
            cos = matrix(b.column("v")) @ centres.T
            of = np.argmax(cos, axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(of)), of], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(angle), b.column("id"), b.column("v")], ["list", "angle", "id", "v"])

    return Index(centres, graph.cut(rows.mapInArrow(put, "list int, angle double, id long, v array<double>")))


def search(index: Index, queries: DataFrame, k: int, probes: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(a, b, rank, similarity): for each query the ``k`` nearest others in the lists of its ``probes`` nearest centres."""
    centres = index.centres
    probes = min(probes, len(centres))

    def visit(batches):
        for b in batches:
            near = np.argsort(-(matrix(b.column("v")) @ centres.T), axis=1)[:, :probes]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.tolist(), pa.list_(pa.int32()))], ["id", "v", "lists"])

    q = queries.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    q = q.mapInArrow(visit, "id long, v array<double>, lists array<int>").select(F.explode("lists").alias("list"), "id", "v")
    size = index.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / 4096).cast("int").alias("parts"))  # a row a list
    size = F.broadcast(size)  # at most LISTS rows
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    here = index.rows.join(size, "list").select("list", part.alias("part"), F.lit(0).alias("side"), "id", "v")
    asks = q.join(size, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "v")

    def meet(t: pa.Table) -> pa.Table:
        side, ids, v = t["side"].to_numpy(), t["id"].to_numpy(), matrix(t["v"])
        x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in np.array_split(x, -(-len(x) // 1024)) if len(x) and len(y) else []:
            sim = v[i] @ v[y].T
            sim[ids[i][:, None] == ids[y][None, :]] = -np.inf
            top = np.argsort(-sim, axis=1)[:, :k]
            a.append(np.repeat(ids[i], top.shape[1]))
            b.append(ids[y][top].ravel())
            s.append(np.take_along_axis(sim, top, axis=1).ravel())
        a, b, s = map(np.concatenate, (a, b, s))
        ok = np.isfinite(s)
        return pa.table({"a": a[ok], "b": b[ok], "similarity": s[ok]})

    best = here.unionByName(asks).groupBy("list", "part").applyInArrow(meet, "a long, b long, similarity double")
    return top_n(best, ["a"], [F.desc("similarity"), F.asc("b")], k, "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (a, b) that were found."""
    hit = exact.select("a", "b").join(found.select("a", "b"), ["a", "b"], "left_semi")
    n = exact.count()
    return hit.count() / n if n else 1.0


def tune(index: Index, queries: DataFrame, rows: DataFrame, k: int, target: float = 0.95, sample: int = 200, key: str = "vec_id", column: str = "embedding") -> int:
    """The fewest probes, in doublings, that reach the target recall on a sample of the queries."""
    some = graph.cut(queries.orderBy(F.xxhash64(key), key).limit(sample))
    exact = graph.cut(vectors.top_k_join(some, rows, k, key, column))
    probes = 1
    while probes < len(index.centres) and recall(search(index, some, k, probes, key, column), exact) < target:
        probes *= 2
    return min(probes, len(index.centres))


def filtered(index: Index, rows: DataFrame, allowed: DataFrame, query: list[float], k: int, exact_limit: int = 5000, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, similarity): the ``k`` nearest of the allowed rows to one query, exactly.

    Few allowed rows are all compared.  Else the lists are visited by their centres'
    distance, twice as many each time, until ``k`` allowed rows are found in them; the worst of
    these bounds the angle, and then every list that can hold a row as near is visited.
    """
    ids = graph.cut(allowed.select(F.col(key).cast("long").alias("id")).distinct())
    q = np.asarray(query, float) / np.linalg.norm(query)
    angle = np.arccos(np.clip(index.centres @ q, -1, 1))
    order = np.argsort(angle)
    best = lambda some: vectors.nearest(some.join(ids, "id", "left_semi"), list(map(float, query)), k, key="id", column="v").select("id", "similarity")
    of = lambda lists: index.rows.where(F.col("list").isin(*map(int, lists)))
    if k < 1 or ids.limit(exact_limit + 1).count() <= exact_limit:
        return best(index.rows)
    probes = 8
    while probes < len(order):
        found = best(of(order[:probes])).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("worst")).first()
        if found["n"] >= k:
            far = float(np.arccos(np.clip(found["worst"], -1, 1))) + SLACK
            wide = {r["list"]: r["wide"] for r in index.rows.groupBy("list").agg(F.max("angle").alias("wide")).collect()}  # a row a list
            return best(of([i for i, w in wide.items() if angle[i] - w <= far]))
        probes *= 2
    return best(index.rows)


def similarity_join(rows: DataFrame, threshold: float, lists: int | None = None, key: str = "vec_id", column: str = "embedding", block_rows: int = 2048, visitors: int = VISITORS) -> DataFrame:
    """Pairs (a < b, similarity) with cosine at or above the threshold, all of them.

    Vectors visit the lists before their own that can hold a partner; a list's own
    vectors are dealt to blocks, and a task compares one block with a slice of its visitors,
    about ``visitors`` at most, so its memory does not follow the number of vectors.
    """
    index = build(rows, lists, key, column)
    centres, far = index.centres, float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    about = {r["list"]: (r["wide"], r["n"]) for r in index.rows.groupBy("list").agg(F.max("angle").alias("wide"), F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    wide = np.array([about.get(i, (-np.inf, 0))[0] for i in range(len(centres))])
    parts = np.array([max(1, -(-about.get(i, (0, 0))[1] // block_rows)) for i in range(len(centres))])

    slices = max(1, -(-sum(n for _, n in about.values()) // visitors))
    step = max(1, min(1024, COPIES // (int(parts.sum()) + slices)))
    mixed = lambda ids: ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def send(b, x, to, part, side, piece):
        for k in range(0, len(x), SENT):
            at, n = slice(k, k + SENT), len(x[k : k + SENT])
            yield pa.RecordBatch.from_arrays([pa.array(to[at], pa.int32()), pa.array(part[at], pa.int32()), pa.array(piece[at], pa.int32()), pa.array(np.full(n, side), pa.int32()), b.column("id").take(pa.array(x[at])), b.column("v").take(pa.array(x[at]))], ["list", "part", "slice", "side", "id", "v"])

    def deal(batches):
        for b in (whole.slice(k, step) for whole in batches for k in range(0, whole.num_rows, step)):
            v, of, ids = matrix(b.column("v")), b.column("list").to_numpy(), b.column("id").to_numpy()
            angle = np.arccos(np.clip(v @ centres.T, -1, 1))
            goes = angle <= wide[None, :] + far
            goes &= np.arange(len(centres))[None, :] <= of[:, None]
            goes[np.arange(len(of)), of] = True
            i, to = np.nonzero(goes)
            n = parts[to]
            own = ids[i] % n
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, to, own = np.repeat(i, n), np.repeat(to, n), np.repeat(own, n)
            home = (to == of[i]) & (part == own)
            ask = ~home & ((to != of[i]) | (part < own))  # blocks of one list meet once
            every = np.flatnonzero(home).repeat(slices)  # a block is in all its slices
            yield from send(b, i[every], to[every], part[every], 0, np.tile(np.arange(slices), int(home.sum())))
            yield from send(b, i[ask], to[ask], part[ask], 1, mixed(ids[i[ask]]) % slices)

    def meet(t: pa.Table) -> pa.Table:
        side, ids, v = t["side"].to_numpy(), t["id"].to_numpy(), matrix(t["v"])
        y, out = np.flatnonzero(side == 0), []
        within = y if t["slice"][0].as_py() == 0 else y[:0]  # a block meets itself once
        for x, inner in ((within, True), (np.flatnonzero(side == 1), False)):
            for i in np.array_split(x, -(-len(x) // 1024)) if len(x) and len(y) else []:
                sim = v[i] @ v[y].T
                p, q = np.nonzero(sim >= threshold)
                a, b, s = ids[i[p]], ids[y[q]], sim[p, q]
                ok = a < b if inner else a != b
                out.append((np.minimum(a, b)[ok], np.maximum(a, b)[ok], s[ok]))
        cols = [np.concatenate([np.zeros(0, kind), *(o[c] for o in out)]) for c, kind in enumerate((np.int64, np.int64, float))]
        return pa.table(dict(zip(("a", "b", "similarity"), cols, strict=True)))

    sent = index.rows.mapInArrow(deal, "list int, part int, slice int, side int, id long, v array<double>")
    return sent.groupBy("list", "part", "slice").applyInArrow(meet, "a long, b long, similarity double")
