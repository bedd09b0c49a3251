"""Ranked lexical search over an inverted index by Block-Max WAND.

The index has *segments* of about 8 MB of text, each written by the task that read it:
no posting is shuffled.  Within a segment documents are numbered by ``doc_id`` and every
term has blocks of at most ``BLOCK`` postings.  A block's row names its first and last
document, its count and its maximum impact in plain columns; document gaps and impacts are
packed into bytes of the least width that holds them.

A search reads the rows of its terms alone and deals them by segment.  There, the ends of
all blocks of a query's terms cut the documents into ranges; the *shallow* pointers of a
range are its blocks' rows, and the sum of their maxima bounds every score within it.
Ranges below the threshold (the least of the best scores so far) are skipped without
unpacking.  In the others, terms that even together stay below the threshold cannot lift
a document by themselves: the remaining terms' documents are the pivots, and of the other
terms only blocks that reach a pivot are unpacked.  Best lists of the segments merge at the end.

Defined cases: null and empty texts hold no term and are neither counted nor found;
rows that repeat a ``doc_id`` are documents of their own; a null ``doc_id`` comes after
all others among equal scores; items that repeat both id and text count once, items
that share an id alone are ranked each; items without a known term have no result;
a text larger than a segment is a segment; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _cuts
from . import _words as W

#: Terms in Java's and DuckDB's notation: maximal runs of all but ASCII marks, controls and blanks.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CLEAN = W.LOWER.copy()
CLEAN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
BLOCK = 128
SEGMENT = 8 << 20
ITEMS = 4 << 20
INDEX = "segment long, term binary, block int, first int, last int, n int, impact long, data binary"


def terms(t: W.Texts) -> tuple[pa.Array, np.ndarray]:
    """Every term occurrence as bytes, and the text that it is in."""
    x = CLEAN[t.data]
    start, end = W.spans(x, t.offsets[:-1])
    at = np.concatenate(([0], np.cumsum(end - start)))
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(x[x != 0x20])])
    return found, np.searchsorted(t.offsets, start, "right") - 1


def _widths(most: np.ndarray) -> np.ndarray:
    """Bytes that hold each number."""
    return 1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)


def pack(gaps: np.ndarray, impacts: np.ndarray, heads: np.ndarray) -> list[bytes]:
    """The blocks that start at ``heads``: two width bytes, then each posting's gap and impact."""
    size = np.diff(np.append(heads, len(gaps)))
    of = np.repeat(np.arange(len(heads)), size)
    wide = [_widths(np.maximum.reduceat(v, heads)) for v in (gaps, impacts)]
    columns = [v.astype("<u4").view(np.uint8).reshape(-1, 4) for v in (gaps, impacts)]
    used = np.concatenate([np.arange(4) < w[of, None] for w in wide], axis=1)
    body = np.concatenate(columns, axis=1)[used]
    ends = np.cumsum(size * (wide[0] + wide[1]))
    whole, lead = body.tobytes(), np.stack(wide, 1).astype(np.uint8).tobytes()
    return [lead[2 * i : 2 * i + 2] + whole[a:b] for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True))]


def unpack(data: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and impacts of a block."""
    a, b = data[0], data[1]
    x = np.frombuffer(data, np.uint8, offset=2).reshape(-1, a + b)
    value = lambda part: (part.astype(np.int64) << (8 * np.arange(part.shape[1]))).sum(1)
    return first + np.cumsum(value(x[:, :a])), value(x[:, a:])


def segment(number: int, ids: list[int | None], t: W.Texts, documents: int, length: int) -> pa.RecordBatch:
    """The rows of one segment: blocks by term, and one row without a term that lists the ids."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    found, of = terms(t)
    found = found.dictionary_encode()
    known = found.dictionary
    pair, tf = np.unique(found.indices.to_numpy().astype(np.int64) * len(ids) + place[of], return_counts=True)
    term, doc = pair // len(ids), pair % len(ids)
    n = np.bincount(place[of], minlength=len(ids))
    m = 75 + (25 * n * documents) // max(length, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
    start = W.heads(term)
    within = np.arange(len(term)) - np.repeat(start, np.diff(np.append(start, len(term))))
    heads = np.flatnonzero(within % BLOCK == 0)
    gaps = np.diff(doc, prepend=0)
    gaps[heads] = 0
    last = np.append(heads[1:], len(doc)) - 1
    present = [ids[i] for i in order if ids[i] is not None]
    cols = {
        "term": pa.concat_arrays([known.take(pa.array(term[heads])).cast(pa.binary()), pa.nulls(1, pa.binary())]),
        "block": np.append(within[heads] // BLOCK, 0),
        "first": np.append(doc[heads], 0),
        "last": np.append(doc[last], len(ids) - 1),
        "n": np.append(last - heads + 1, len(present)),
        "impact": np.append(np.maximum.reduceat(impact, heads) if len(heads) else impact, 0),
        "data": [*(pack(gaps, impact, heads) if len(heads) else []), np.array(present, np.int64).tobytes()],
    }
    kinds = {"term": pa.binary(), "impact": pa.int64(), "data": pa.binary()}
    made = {"segment": pa.array([number] * (len(heads) + 1), pa.int64())} | {k: pa.array(v, kinds.get(k, pa.int32())) if k != "term" else v for k, v in cols.items()}
    return pa.RecordBatch.from_pydict(made)


def _index(documents: int, length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, ids, bytes_held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            column, i = batch.column("text"), 0
            lengths = np.diff(W.texts(column).offsets)
            while i < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(lengths[i:]), size - bytes_held, "right"))
                j = min(batch.num_rows, i + max(room, not held))
                if j > i:
                    held.append(column.slice(i, j - i))
                    ids += batch.column("doc_id").slice(i, j - i).to_pylist()
                    bytes_held += int(lengths[i:j].sum())
                    i = j
                if i < batch.num_rows:
                    yield segment(base, ids, W.texts(pa.chunked_array(held)), documents, length)
                    base, held, ids, bytes_held = base + 1, [], [], 0
        if ids:
            yield segment(base, ids, W.texts(pa.chunked_array(held)), documents, length)

    return run


def build(docs: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, int]:
    """The written index of every row that has a term, and the number of such rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = F.regexp_count("text", F.lit(TERM))
    documents, length = rows.agg(F.sum((n > 0).cast("long")), F.sum(n.cast("long"))).first()
    index = rows.where(F.col("text").rlike(TERM)).mapInArrow(_index(documents or 0, length or 0, size), INDEX)
    return _cuts.written(index), documents or 0


class Lists:
    """Blocks of one segment by term, unpacked on first use; ``unpacked`` counts them."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("term", "ascending"), ("block", "ascending")])
        self.first, self.last, self.impact = (rows[c].to_numpy().astype(np.int64) for c in ("first", "last", "impact"))
        self.data, names = rows["data"].to_pylist(), rows["term"].to_pylist()
        at = [i for i, x in enumerate(names) if not i or x != names[i - 1]]
        self.of = {names[a]: slice(a, b) for a, b in zip(at, [*at[1:], len(names)], strict=False)}
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unpacked = 0

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for i in blocks.tolist():
            if i not in self.kept:
                self.kept[i] = unpack(self.data[i], int(self.first[i]))
                self.unpacked += 1
        found = [self.kept[i] for i in blocks.tolist()]
        return np.concatenate([d for d, _ in found]), np.concatenate([x for _, x in found])


def best(lists: Lists, query: list[tuple[bytes, int]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of largest score above 0 (ties: smallest number), and their scores."""
    known = [(lists.of[t], w) for t, w in query if w > 0 and t in lists.of]
    none = np.zeros(0, np.int64)
    if not known:
        return none, none
    known.sort(key=lambda x: x[1] * int(lists.impact[x[0]].max()))
    tops = np.cumsum([w * int(lists.impact[s].max()) for s, w in known])
    ends = np.unique(np.concatenate([lists.last[s] for s, _ in known]))
    bound, shallow = np.zeros(len(ends), np.int64), []
    for s, w in known:
        b = np.searchsorted(lists.last[s], ends)
        on = b < s.stop - s.start
        on[on] = lists.first[s][b[on]] <= ends[on]
        bound[on] += w * lists.impact[s][b[on]]
        shallow.append(np.where(on, b, -1))
    order = np.argsort(-bound, kind="stable")
    score, chosen, least, step, at = np.zeros(docs, np.int64), none, 1, 4, 0
    while at < len(order) and bound[order[at]] >= least:
        ranges = order[at : at + step]
        ranges = ranges[bound[ranges] >= least]
        at, step = at + step, step * 2
        within = np.zeros(len(ends) + 1, bool)
        within[ranges] = True
        weak = int(np.searchsorted(tops, least))  # so many terms stay below the threshold together
        pivot = np.zeros(docs, bool)
        for j in [*range(weak, len(known)), *range(weak)]:
            s, w = known[j]
            if j >= weak:
                blocks = np.unique(shallow[j][ranges])
                blocks = blocks[blocks >= 0]
            else:
                blocks = np.unique(np.searchsorted(lists.last[s], np.flatnonzero(pivot)))
                blocks = blocks[blocks < s.stop - s.start]
            if not len(blocks):
                continue
            d, x = lists.postings(blocks + s.start)
            if j >= weak:
                on = within[np.searchsorted(ends, d)]
                d, x = d[on], x[on]
                pivot[d] = True
            else:
                on = pivot[d]
                d, x = d[on], x[on]
            score[d] += w * x
        chosen = np.concatenate((chosen, np.flatnonzero(pivot)))
        chosen = chosen[np.lexsort((chosen, -score[chosen]))][:k]
        chosen = chosen[score[chosen] > 0]
        if len(chosen) == k:
            least = int(score[chosen[-1]])
    return chosen, score[chosen]


def _search(queries: list[tuple[int, list[tuple[bytes, int]]]], k: int):
    def run(rows: pa.Table) -> pa.Table:
        blank = rows["term"].is_null()
        names = rows.filter(blank)
        ids, docs = np.frombuffer(names["data"][0].as_py(), np.int64), names["last"][0].as_py() + 1
        lists, out = Lists(rows.filter(pc.invert(blank))), []
        for number, query in queries:
            d, score = best(lists, query, docs, k)
            out += [(number, int(ids[i]) if i < len(ids) else None, s) for i, s in zip(d.tolist(), score.tolist(), strict=True)]
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("query", "doc_id", "score"))})

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, of = terms(W.texts(batch.column("text")))
        number = batch.column("query").to_numpy()[of]
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), found.cast(pa.binary())], ["query", "term"])


def rank(docs: DataFrame, items: DataFrame, k: int = 20, size: int = SEGMENT, items_bytes: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of every item's ``k`` best documents."""
    return search(*build(docs, size), items, k, items_bytes)


def search(index: DataFrame, documents: int, items: DataFrame, k: int = 20, items_bytes: int = ITEMS) -> DataFrame:
    """As ``rank``, over a written index.  Items go to the tasks in blocks of about ``items_bytes`` of text."""
    spark = index.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / items_bytes))
    items = _cuts.written(items.withColumns({"part": F.pmod(F.xxhash64("text"), F.lit(blocks)), "query": F.monotonically_increasing_id()}))
    asked = items.select("query", "text").mapInArrow(_item_terms, "query long, term binary")
    asked = _cuts.written(asked.groupBy("query", "term").count().join(items.select("query", "part"), "query"))
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    for part in range(blocks):
        mine = asked.where(F.col("part") == part)
        lists = index.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi")  # terms of one block of items
        df = lists.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
        rows = mine.join(df, "term").select("query", "term", (weight * F.col("count")).cast("long").alias("w")).collect()  # one block
        queries: dict[int, list[tuple[bytes, int]]] = {}
        for r in rows:
            queries.setdefault(r.query, []).append((bytes(r.term), r.w))
        if queries:
            held = lists.select(*index.columns).union(index.where("term is null"))
            found = found.union(held.groupBy("segment").applyInArrow(_search(sorted(queries.items()), k), found.schema))
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return top.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
