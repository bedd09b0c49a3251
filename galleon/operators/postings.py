"""A stored inverted index: built once, kept up to date from a journal, searched for the best few.

Under one folder lie, by *generation* (one for the build and one for each batch of changes):

* ``blocks``: postings by bucket of the term and slice of the ids, at most ``BLOCK`` a row,
  with the greatest frequency and the least length in it, which bound every score it can give;
* ``terms``: by bucket, in how many more (or fewer) documents a term is;
* ``docs``: by part of the ids, every document's length and terms, for later changes;
* ``dead``: ids whose older postings no longer count;
* ``manifest``: one row with the change of the number of documents and of words.  It is
  written last: a generation without it is not there.

A search reads the buckets of its terms only.  It first reads the blocks' bounds
without their postings: within a slice the bounds of all terms are summed over every range of ids.
The blocks that reach highest are scored first; the k-th best of these partial scores
is a floor, and only blocks whose ranges can reach it are read and summed.

A term that very many documents hold is spread over the slices, so no task has it whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stems
from . import graph, windows

BLOCK = 128
WORDS = r"([\w']+)"
K1, B = 1.2, 0.75
FOUND = "id long, len int, terms array<string>, tfs array<int>"


class Index(NamedTuple):
    """Where an index lies and how it is cut; the same values must be given to every use."""

    path: str
    buckets: int = 64
    slices: int = 1
    stemmed: bool = True


def _terms(stemmed: bool):
    """Distinct terms of every row with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            size = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten()
            coded = stems.stems(flat) if stemmed else flat.dictionary_encode()
            names = coded.dictionary.dictionary_encode()  # two words may have one stem
            code = names.indices.to_numpy().astype(np.int64)[coded.indices.to_numpy()]
            n = max(1, len(names.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + code, return_counts=True)
            at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(pair // n, minlength=len(size))))), pa.int32())
            terms = pa.ListArray.from_arrays(at, names.dictionary.take(pa.array(pair % n)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int32()), terms, pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], ["id", "len", "terms", "tfs"])

    return run


def analyse(docs: DataFrame, key: str, text: str, stemmed: bool) -> DataFrame:
    """(id, len, terms, tfs) of every document; null text has no words."""
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 1), F.array().cast("array<string>"))
    return docs.select(F.col(key).cast("long").alias("id"), words.alias("words")).mapInArrow(_terms(stemmed), FOUND)


def _bucket(index: Index, term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(index.buckets)).cast("int")


def _slice(index: Index, key: str = "id"):
    return F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(index.slices)).cast("int")


def _write(rows: DataFrame, index: Index, kind: str, generation: int, by: str | None = None) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(f"{index.path}/{kind}/_g={generation}")


def _read(spark: SparkSession, index: Index, kind: str, schema: str) -> DataFrame:
    """All complete generations of a kind."""
    known = generations(spark, index)
    rows = spark.read.schema(schema).option("basePath", f"{index.path}/{kind}").parquet(*(f"{index.path}/{kind}/_g={g}" for g in known))
    return rows.where(F.col("_g").isin(known))


BLOCKS = f"slice int, term string, block long, first long, last long, n int, most int, least int, postings array<struct<id:long,tf:int,len:int>>, _g int, _b int"


def generations(spark: SparkSession, index: Index) -> list[int]:
    """Generations whose manifest is there."""
    try:
        return sorted(r["_g"] for r in spark.read.schema("docs long, words long, _g int").option("basePath", f"{index.path}/manifest").parquet(f"{index.path}/manifest").select("_g").distinct().collect())
    except AnalysisException:
        return []


LISTS = "slice int, term string, id array<long>, tf array<int>, len array<int>"
PACKED = "_b int, slice int, term string, block long, first long, last long, n int, most int, least int, postings array<struct<id:long,tf:int,len:int>>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (slice, id, len, terms, tfs) as lists by slice and term of the batch's documents: fewer rows to deal and sort."""
    for batch in batches:
        terms = batch.column("terms")
        size = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        n = max(1, len(coded.dictionary))
        key = np.repeat(batch.column("slice").to_numpy().astype(np.int64), size) * n + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        at = pa.array(np.append(starts, len(key)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (np.repeat(batch.column("id").to_numpy(), size), batch.column("tfs").flatten().to_numpy(), np.repeat(batch.column("len").to_numpy(), size))]
        yield pa.RecordBatch.from_arrays([pa.array(key[starts] // n, pa.int32()), coded.dictionary.take(pa.array(key[starts] % n)), *lists], ["slice", "term", "id", "tf", "len"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lists (_b, slice, term, id, tf, len) sorted by the first three; a term's lists may go on in the next batch."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if rows.num_rows:
            new = _fresh(rows)
            last = int(np.flatnonzero(new)[-1])
            held = rows.slice(last).combine_chunks().to_batches()[0]
            if last:
                yield _blocks(rows.slice(0, last).combine_chunks(), new[:last])
    if held is not None:
        rows = pa.Table.from_batches([held])
        yield _blocks(rows, _fresh(rows))


def _fresh(rows: pa.Table) -> np.ndarray:
    """Which rows are the first of their term in their slice."""
    b, part, term = rows["_b"].to_numpy(), rows["slice"].to_numpy(), rows["term"].combine_chunks()
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (part[1:] != part[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
    return new


def _blocks(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
    """Every term's postings by id, at most ``BLOCK`` a row."""
    run = np.repeat(np.cumsum(new) - 1, pc.list_value_length(rows["id"]).to_numpy())
    ids, tf, size = (rows[c].combine_chunks().flatten().to_numpy() for c in ("id", "tf", "len"))
    order = np.lexsort((ids, run))
    ids, tf, size = ids[order], tf[order], size[order]  # runs are in order already
    begin = np.searchsorted(run, np.arange(int(run[-1]) + 1))
    place = np.arange(len(ids)) - begin[run]
    starts = np.flatnonzero(place % BLOCK == 0)
    ends = np.append(starts[1:], len(ids))
    head = pa.array(np.flatnonzero(new)[run[starts]])
    each = pa.StructArray.from_arrays([pa.array(x) for x in (ids, tf, size)], ["id", "tf", "len"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), each)
    named = [rows[c].combine_chunks().take(head) for c in ("_b", "slice", "term")]
    more = (place[starts] // BLOCK, ids[starts], ids[ends - 1], (ends - starts).astype(np.int32), np.maximum.reduceat(tf, starts), np.minimum.reduceat(size, starts))
    return pa.RecordBatch.from_arrays([*named, *map(pa.array, more), lists], ["_b", "slice", "term", "block", "first", "last", "n", "most", "least", "postings"])


def _add(index: Index, generation: int, new: DataFrame, old: DataFrame | None) -> None:
    """Writes a generation: ``new`` documents (id, len, terms, tfs) in place of ``old`` ones."""
    each = new.select(_slice(index).alias("slice"), "id", "len", "terms", "tfs").mapInArrow(_gather, LISTS)
    each = each.select(_bucket(index).alias("_b"), "slice", "term", "id", "tf", "len").repartition("_b", "slice")
    rows = each.sortWithinPartitions("_b", "slice", "term").mapInArrow(_pack, PACKED)
    _write(rows.sortWithinPartitions("_b", "term", "slice", "block"), index, "blocks", generation, "_b")
    change = new.select(F.explode("terms").alias("term"), F.lit(1).alias("n"))
    if old is not None:
        change = change.unionByName(old.select(F.explode("terms").alias("term"), F.lit(-1).alias("n")))
        _write(old.select("id"), index, "dead", generation)
    _write(change.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0").withColumn("_b", _bucket(index)).repartition("_b"), index, "terms", generation, "_b")
    _write(new.withColumn("_p", _slice(index)), index, "docs", generation, "_p")
    size = new.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
    if old is not None:
        was = old.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("len"), F.lit(0)).alias("w"))
        size = size.crossJoin(was).select((F.col("docs") - F.col("d")).alias("docs"), (F.col("words") - F.col("w")).alias("words"))  # one row each
    _write(size.coalesce(1), index, "manifest", generation)


def build(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> Index:
    """Writes the first generation of an index over all rows; ``key`` is unique."""
    _add(index, 0, graph.cut(analyse(docs, key, text, index.stemmed)), None)
    return index


def live(spark: SparkSession, index: Index) -> DataFrame:
    """(id, len, terms, tfs) of the documents as they are now."""
    rows = _read(spark, index, "docs", FOUND + ", _g int, _p int")
    return rows.join(_last_dead(spark, index), "id", "left").where("gone is null or _g >= gone").drop("gone", "_g", "_p")


def _last_dead(spark: SparkSession, index: Index) -> DataFrame:
    """(id, gone): postings of an id older than generation ``gone`` no longer count."""
    if generations(spark, index)[-1:] in ([], [0]):
        return spark.createDataFrame([], "id long, gone int")
    known = [g for g in generations(spark, index) if g]
    rows = spark.read.schema("id long, _g int").option("basePath", f"{index.path}/dead").parquet(*(f"{index.path}/dead/_g={g}" for g in known))
    return rows.groupBy("id").agg(F.max("_g").alias("gone"))


def update(journal: DataFrame, index: Index, generation: int, key: str = "doc_id", text: str = "text", seq: str = "seq", deleted: str = "deleted") -> bool:
    """Applies a batch of changes as a generation of its own; a generation that is complete is left alone.

    The greatest ``seq`` of a key counts.  Writing a generation again after a failure replaces it.
    """
    spark = journal.sparkSession
    if generation in generations(spark, index):
        return False
    last = graph.cut(windows.best(journal, [key], [F.col(seq)]).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(deleted).alias("deleted")))
    old = graph.cut(live(spark, index).join(last.select("id"), "id", "left_semi"))
    new = graph.cut(analyse(last.where("not deleted"), "id", "text", index.stemmed))
    _add(index, generation, new, old)
    return True


def compact(spark: SparkSession, index: Index, path: str) -> Index:
    """The same index in one generation at another place."""
    new = index._replace(path=path)
    _add(new, 0, graph.cut(live(spark, index)), None)
    return new


def _reach(rows: pa.Table) -> pa.Table:
    """For every block of a slice, the most that the terms' bounds sum to over its range of ids."""
    first, last, bound = (rows[c].to_numpy() for c in ("first", "last", "bound"))
    at = np.unique(np.concatenate((first, last + 1)))
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, last + 1)
    total = np.cumsum(np.bincount(lo, bound, len(at)) - np.bincount(hi, bound, len(at)))
    # maxima of ranges by doubling tables
    tables = [total]
    while 2 << (len(tables) - 1) <= len(total):
        half = 1 << (len(tables) - 1)
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))
    level = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(int)
    most = np.array([max(tables[k][a], tables[k][b - (1 << k)]) for k, a, b in zip(level, lo, hi, strict=True)], float)
    return rows.drop_columns(["first", "last"]).append_column("reach", pa.array(most))


def query_terms(text: str, stemmed: bool, limit: int = 8) -> list[str]:
    """The first words of more than two letters of a search, as terms."""
    words = [w for w in re.findall(r"[\w']+", text.lower()) if len(w) > 2][:limit]
    return list(dict.fromkeys(stems.stem(w) if stemmed else w for w in words))


def search(spark: SparkSession, index: Index, terms: list[str], k: int, allowed: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(id, score): the ``k`` best documents that hold one of the terms, by Okapi BM25; ties by id.

    Statistics are those of all documents; ``allowed`` (id) only filters.  With ``digits``
    scores are rounded before they are ranked.
    """
    none = spark.createDataFrame([], "id long, score double")
    if not terms or not generations(spark, index):
        return none
    stats = _read(spark, index, "manifest", "docs long, words long, _g int").agg(F.sum("docs").alias("n"), F.sum("words").alias("w")).first()
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").withColumn("_b", _bucket(index)).collect()
    mine = F.col("_b").isin(*{r["_b"] for r in wanted}) & F.col("term").isin(terms)  # the buckets' folders are pruned
    df = {r["term"]: r["n"] for r in _read(spark, index, "terms", "term string, n long, _g int, _b int").where(mine).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weights = {t: float(np.log(1 + (stats["n"] - n + 0.5) / (n + 0.5))) for t, n in df.items() if n > 0}
    if not weights:
        return none
    mean = stats["w"] / stats["n"]
    idf = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    part = lambda tf, size: idf[F.col("term")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(mean)))
    blocks = _read(spark, index, "blocks", BLOCKS).where(mine & F.col("term").isin(*weights))
    bounds = blocks.select("slice", "term", "block", "_g", "first", "last", part(F.col("most"), F.col("least")).alias("bound"))
    out = "slice int, term string, block long, _g int, bound double, reach double"
    reach = graph.cut(bounds.groupBy("slice").applyInArrow(_reach, out))
    key = ["slice", "term", "block", "_g"]
    dead = _last_dead(spark, index)

    def scored(chosen: DataFrame) -> DataFrame:
        rows = blocks.join(chosen.select(*key), key, "left_semi").select("term", "_g", F.inline("postings"))
        rows = rows.join(dead, "id", "left").where("gone is null or _g >= gone")
        if allowed is not None:
            rows = rows.join(allowed.select("id"), "id", "left_semi")
        total = rows.groupBy("id").agg(F.sum(part(F.col("tf"), F.col("len"))).alias("score"))
        return total.withColumn("score", F.round("score", digits)) if digits is not None else total

    first = reach.orderBy(F.desc("reach"), F.desc("bound")).limit(len(terms) * (2 + k // BLOCK))
    top = scored(F.broadcast(first)).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).first()
    floor = top["floor"] - 10.0 ** -(digits if digits is not None else 9) if top["n"] == k else 0.0
    return scored(reach.where(F.col("reach") >= floor)).orderBy(F.desc("score"), "id").limit(k)
