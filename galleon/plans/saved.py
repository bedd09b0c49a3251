"""Saved searches: stored as structs, run as plans, and matched in reverse against new items.

A saved search runs like any other (``run``), so a smart collection is always what it says now.
The other way round, ``matches`` finds for a batch of items every saved search that would show them,
without running the searches: each search is filed under one predicate that all its
matches must meet, the rarest it has (a person of those it asks for all of, or each of several of which one
is enough; a word; a kind within a month; a kind; or nothing at all).  Items look up what they have by one
join (a shuffle where there are very many searches), and only what they meet there is tested in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import facets, windows
from . import search

QUERY = "struct<words:array<string>,people:array<bigint>,exclude:array<bigint>,mode:string,kind:string,date_from:string,date_to:string,min_quality:double>"
SAVED = f"search_id bigint, name string, query {QUERY}"
MONTHS_AT_MOST = 24  # a longer span is filed under its kind
SENT_KEYS = 100_000  # predicates at most that are sent to every task


def save(spark, rows: list[tuple[int, str, search.HybridQuery]]) -> DataFrame:
    """The table of saved searches (search_id, name, query); paging and weights are those of the reader."""
    kind = StructType.fromDDL(SAVED)
    data = [(i, n, (search.postings_words(q.text), list(q.people), list(q.exclude), q.mode, q.kind, q.date_from, q.date_to, q.min_quality)) for i, n, q in rows]
    return spark.createDataFrame(data, kind)


def load(saved: DataFrame, search_id: int) -> search.HybridQuery:
    """One saved search as a query."""
    q = saved.where(F.col("search_id") == search_id).select("query.*").first()
    return search.HybridQuery(text=" ".join(q["words"]), people=tuple(q["people"]), exclude=tuple(q["exclude"]), mode=q["mode"], kind=q["kind"], date_from=q["date_from"], date_to=q["date_to"], min_quality=q["min_quality"])


def run(saved: DataFrame, search_id: int, media: DataFrame, faces: DataFrame, captions: DataFrame) -> DataFrame:
    """Ids of the live media that a saved search shows: its filters, and one of its words where it has any."""
    q = load(saved, search_id)
    rows = search.filtered(q, media, faces).select("id")
    words = search.postings_words(q.text)
    if words:
        has = captions.where(F.arrays_overlap(search.words_of(F.col("caption")), F.array(*map(F.lit, words)))).select("id")
        rows = rows.join(has, "id", "left_semi")
    return rows


def _described(items: DataFrame, faces: DataFrame, captions: DataFrame) -> DataFrame:
    """Live items with what searches ask about: people, best quality, words."""
    live = items.where("deleted_at is null and missing = 0").select("id", "kind", "captured_at")
    seen = faces.where("deleted_at is null").join(live.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    people = F.collect_set(F.when(F.col("review_state") != "rejected", F.col("person_id")))
    about = seen.groupBy(F.col("media_id").alias("id")).agg(people.alias("people"), F.max("quality").alias("quality"))  # the faces of one item
    words = captions.select("id", search.words_of(F.col("caption")).alias("words"))
    none = F.array()
    return live.join(about, "id", "left").join(words, "id", "left").select("id", "kind", "captured_at", "quality", F.coalesce("people", none.cast("array<bigint>")).alias("people"), F.coalesce("words", none.cast("array<string>")).alias("words"))


def _month(at):
    return F.date_format(at, "yyyy-MM")


def _filed(saved: DataFrame, people: DataFrame) -> DataFrame:
    """(how, what, search_id): the one predicate, or its few alternatives, under which each search is found."""
    q = F.col("query")
    asked = saved.select("search_id", "query", F.explode_outer(q["people"]).alias("person_id")).join(people, "person_id", "left")
    rare = windows.best(asked.select("search_id", F.coalesce("n", F.lit(0)).alias("n"), "person_id"), ["search_id"], [-F.col("n"), -F.col("person_id")]).select("search_id", F.col("person_id").alias("rarest"))
    rows = saved.join(rare, "search_id")
    kind = F.coalesce(q["kind"], F.lit("*"))
    dated = q["date_from"].isNotNull() & q["date_to"].isNotNull()
    first, last = F.to_date(F.substring(q["date_from"], 1, 10)), F.to_date(F.substring(q["date_to"], 1, 10))
    span = F.when(dated, F.months_between(F.trunc(last, "month"), F.trunc(first, "month"))).cast("int")
    months = F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce(span, F.lit(0)), F.lit(0))), lambda i: F.concat(kind, F.lit(" "), F.date_format(F.add_months(F.trunc(first, "month"), i), "yyyy-MM")))
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    key = lambda how, what: F.struct(F.lit(how).alias("how"), what.alias("what"))
    filed = (
        F.when((F.size(q["people"]) > 0) & (q["mode"] == "OR"), key("person", text(q["people"])))
        .when(F.size(q["people"]) > 0, key("person", F.array(F.col("rarest").cast("string"))))
        .when(F.size(q["words"]) > 0, key("word", q["words"]))
        .when(dated & span.between(0, MONTHS_AT_MOST), key("month", months))
        .otherwise(key("kind", F.array(kind)))
    )
    return rows.select("search_id", filed.alias("f")).select(F.col("f.how").alias("how"), F.explode(F.array_distinct("f.what")).alias("what"), "search_id")


def matches(saved: DataFrame, items: DataFrame, faces: DataFrame, captions: DataFrame) -> DataFrame:
    """(search_id, id) of every item that a saved search shows, as ``run`` of every search would tell.

    ``items`` are media rows (new ones, or all); ``faces`` and ``captions`` may hold more than theirs.
    """
    x = _described(items, faces, captions)
    known = x.select(F.explode("people").alias("person_id")).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(F.coalesce("kind", F.lit("*")), F.lit("*"))
    key = lambda how, what: F.transform(what, lambda w: F.struct(F.lit(how).alias("how"), w.cast("string").alias("what")))
    at = F.transform(kinds, lambda k: F.concat(k, F.lit(" "), F.coalesce(_month(F.col("captured_at")), F.lit("-"))))
    has = F.array_distinct(F.concat(key("person", F.col("people")), key("word", F.col("words")), key("month", at), key("kind", kinds)))
    filed, q = _filed(saved, known), F.col("query")
    most = saved.agg(F.sum(F.size(q["people"]) + F.size(q["words"]) + MONTHS_AT_MOST + 1)).first()[0] or 0
    # few predicates are sent along, so that items stay where they are
    sent = F.broadcast if most <= SENT_KEYS else lambda df: df
    near = x.select("id", F.inline(has)).join(sent(filed), ["how", "what"]).select("id", "search_id").distinct()
    rows = near.join(x, "id").join(sent(saved.select("search_id", "query")), "search_id")
    day = F.date_add(F.to_date(F.substring(q["date_to"], 1, 10)), 1).cast("timestamp_ntz")
    fits = (
        (q["kind"].isNull() | ~q["kind"].isin("photo", "video") | (F.col("kind") == q["kind"]))
        & (q["date_from"].isNull() | (F.col("captured_at") >= q["date_from"].cast("timestamp_ntz")))
        & (q["date_to"].isNull() | (F.col("captured_at") < day))
        & (q["min_quality"].isNull() | (F.col("quality") >= q["min_quality"]))
        & ((F.size(q["words"]) == 0) | F.arrays_overlap("words", q["words"]))
        & ((F.size(q["people"]) == 0) | F.when(q["mode"] == "OR", F.arrays_overlap("people", q["people"])).otherwise(F.size(F.array_except(q["people"], F.col("people"))) == 0))
        & ~F.arrays_overlap("people", q["exclude"])
    )
    return rows.where(fits).select("search_id", "id")
