"""Hybrid search: a query in words becomes filters and ranked signals, fused by reciprocal rank."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import facets, text, vectors

# Words of the query language.
MONTHS = {m.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, m in enumerate(names) if m}
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}
KINDS = {"photo": "photo", "photos": "photo", "picture": "photo", "pictures": "photo", "image": "photo", "images": "photo", "video": "video", "videos": "video", "clip": "video", "clips": "video"}
YEAR = r"19\d\d|20\d\d|2100"
FILLER = frozenset("show me find all my the a an of with in on at from to by and or please any some".split())


@dataclass(frozen=True)
class HybridQuery:
    """What a search asks for; unset fields do not filter."""

    text: str = ""
    people: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    mode: str = "AND"
    kind: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_quality: float | None = None
    vector: tuple[float, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: {"vector": 1.0, "text": 1.0, "recency": 0.0})
    page: int = 1
    size: int = 50


def _month(year: int, month: int) -> tuple[date, date]:
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def _last_begun(name: str, today: date) -> int:
    """The year in which the latest such season began."""
    return today.year - (date(today.year, SEASONS[name], 1) > today)


def _season(name: str, year: int) -> tuple[date, date]:
    first = SEASONS[name]
    end = (year + 1, 2) if first == 12 else (year, first + 2)
    return date(year, first, 1), _month(*end)[1]


def parse_dates(words: str, today: date) -> tuple[str | None, str | None, str]:
    """(from, to, rest): day, week, month, season and year phrases; since/after and before/until bound one side.

    Weeks start on Monday; a later phrase replaces an earlier one.
    """
    monday = today - timedelta(days=today.weekday())
    last_month = (today.replace(day=1) - timedelta(days=1))
    spans: list[tuple[str, object]] = [
        (r"today", lambda m: (today, today)),
        (r"yesterday", lambda m: (today - timedelta(days=1),) * 2),
        (r"this week", lambda m: (monday, monday + timedelta(days=6))),
        (r"last week", lambda m: (monday - timedelta(days=7), monday - timedelta(days=1))),
        (r"this month", lambda m: _month(today.year, today.month)),
        (r"last month", lambda m: _month(last_month.year, last_month.month)),
        (r"this year", lambda m: (date(today.year, 1, 1), date(today.year, 12, 31))),
        (r"last year", lambda m: (date(today.year - 1, 1, 1), date(today.year - 1, 12, 31))),
        (rf"(last|this) ({'|'.join(SEASONS)})", lambda m: _season(m[2], today.year - (m[1] == "last"))),
        (rf"({'|'.join(SEASONS)})(?: ({YEAR}))?", lambda m: _season(m[1], int(m[2]) if m[2] else _last_begun(m[1], today))),
        (rf"({'|'.join(MONTHS)})(?: ({YEAR}))?", lambda m: _month(int(m[2]) if m[2] else today.year - (MONTHS[m[1]] > today.month), MONTHS[m[1]])),
        (rf"({YEAR})", lambda m: (date(int(m[1]), 1, 1), date(int(m[1]), 12, 31))),
    ]
    low = high = None
    rest, found = " ".join(w.strip(",.") for w in words.lower().split()), []
    for pattern, span in spans:
        for m in re.finditer(rf"(?<!\S)(?P<prep>(?:since|after|from|before|until|in|during|on) )?(?P<what>{pattern})(?!\S)", rest):
            inner = re.fullmatch(pattern, m["what"])
            found.append((m.start(), (m["prep"] or "").strip(), *span(inner)))
            rest = rest[: m.start()] + " " * (m.end() - m.start()) + rest[m.end() :]
    for _, prep, a, b in sorted(found):
        if prep in ("since", "after", "from"):
            low = a
        elif prep in ("before", "until"):
            high = a - timedelta(days=1)
        else:
            low, high = a, b
    return low and low.isoformat(), high and high.isoformat(), " ".join(rest.split())


def match_people(words: str, people: DataFrame) -> tuple[tuple[int, ...], str]:
    """Ids of people (id, name and, where known, face_count) named in the words, and the other words.

    From left to right the longest phrase of up to three words that is a whole name counts;
    else a word of three letters or more that lies in one person's name only.  People
    without faces are not looked for; ids come by the length of their phrase.
    """
    tokens = words.lower().split()
    phrases = {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}
    if not phrases:
        return (), words
    if "face_count" in people.columns:
        people = people.where("face_count > 0")
    low = F.lower("name")
    whole = people.where(low.isin(*phrases)).groupBy(low.alias("key")).agg(F.min("id").alias("id")).collect()  # a row a phrase
    known = {r.key: r.id for r in whole}
    parts = sorted({t for t in tokens if len(t) > 2 and t not in FILLER})
    if parts:
        row = people.agg(*(F.count_if(F.contains(low, F.lit(t))).alias(f"n{i}") for i, t in enumerate(parts)), *(F.min(F.when(F.contains(low, F.lit(t)), F.col("id"))).alias(f"i{i}") for i, t in enumerate(parts))).first()
        known |= {t: row[f"i{i}"] for i, t in enumerate(parts) if row[f"n{i}"] == 1 and t not in known}
    found, left, i = [], [], 0
    original = words.split()
    while i < len(tokens):
        n = next((n for n in (3, 2, 1) if i + n <= len(tokens) and " ".join(tokens[i : i + n]) in known), 0)
        if n:
            found.append((-n, i, known[" ".join(tokens[i : i + n])]))
        else:
            left.append(original[i])
        i += n or 1
    return tuple(dict.fromkeys(who for *_, who in sorted(found))), " ".join(left)


def parse(words: str, today: date, people: DataFrame | None = None) -> HybridQuery:
    """A query from words: dates, people, kind and mode are taken out, the rest is text."""
    low, high, rest = parse_dates(words, today)
    ids: tuple[int, ...] = ()
    if people is not None:
        ids, rest = match_people(rest, people)
    mode = "OR" if re.search(r"\bor\b", rest) and len(ids) > 1 else "AND"
    tokens = rest.split()
    kind = next((KINDS[t] for t in tokens if t in KINDS), None)
    left = [t for t in tokens if t not in KINDS and t not in FILLER]
    return HybridQuery(text=" ".join(left), people=ids, mode=mode, kind=kind, date_from=low, date_to=high)


def filtered(q: HybridQuery, media: DataFrame, faces: DataFrame) -> DataFrame:
    """Live media that pass the filters; each is a predicate or a semi or anti join."""
    rows = media.where("deleted_at is null and missing = 0")
    if q.kind in ("photo", "video"):
        rows = rows.where(F.col("kind") == q.kind)
    rows = rows.where(facets.date_range(F.col("captured_at"), q.date_from, q.date_to))
    links = faces.where("deleted_at is null and review_state <> 'rejected'").select(F.col("media_id").alias("id"), "person_id")
    if q.people:
        rows = (facets.with_any if q.mode == "OR" else facets.with_all)(rows, links, "id", "person_id", q.people)
    if q.exclude:
        rows = rows.join(links.where(F.col("person_id").isin(*q.exclude)), "id", "left_anti")
    if q.min_quality is not None:
        rows = rows.join(faces.where(F.col("deleted_at").isNull() & (F.col("quality") >= q.min_quality)).select(F.col("media_id").alias("id")), "id", "left_semi")
    return rows


def postings_words(words: str) -> list[str]:
    """The words that a text search looks for."""
    return [t for t in re.findall(r"[\w']+", words.lower()) if len(t) > 2][:8]


def words_of(column: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"([\w']+)"), 1))


def search(q: HybridQuery, media: DataFrame, faces: DataFrame, embeddings: DataFrame, captions: DataFrame) -> DataFrame:
    """(id, score, n_signals) of a page; without signals the newest first with no score."""
    rows = filtered(q, media, faces)
    depth = max(3 * q.page * q.size, 300)
    alive = rows.select("id")
    signals = []
    if q.vector:
        near = vectors.nearest(embeddings.join(alive, "id", "left_semi"), list(q.vector), depth, key="id")
        signals.append(near.select(F.lit("vector").alias("signal"), "id", F.col("similarity").alias("value")))
    tokens = postings_words(q.text)
    if tokens:
        found = text.bm25(captions.join(alive, "id", "left_semi"), tokens, key="id", text="caption").orderBy(F.desc("score"), F.desc("id")).limit(depth)
        signals.append(found.select(F.lit("text").alias("signal"), "id", F.col("score").alias("value")))
    order = [F.desc("captured_at"), F.desc("id")]
    if not signals:
        return facets.page(rows.select("id", F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("n_signals"), "captured_at"), order, q.page, q.size).drop("captured_at")
    if q.weights.get("recency", 0) > 0:
        newest = rows.orderBy(*order).limit(depth)
        signals.append(newest.select(F.lit("recency").alias("signal"), "id", F.unix_micros(F.col("captured_at").cast("timestamp")).cast("double").alias("value")))
    every = signals[0]
    for s in signals[1:]:
        every = every.unionByName(s)
    rank = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("value"), F.desc("id")))
    fused = vectors.rrf(every.withColumn("rank", rank), q.weights)
    return facets.page(fused, [F.desc("score"), F.desc("id")], q.page, q.size)


def relaxed(q: HybridQuery) -> HybridQuery:
    """The query without its text, for when nothing was found and filters remain."""
    return replace(q, text="", vector=())
