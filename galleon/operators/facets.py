"""Faceted predicates, sorting and paging: every filter is a semi or anti join or a column predicate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def contains(column: Column, text: str, raw_wildcards: bool = False) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` of the text are literal unless ``raw_wildcards``."""
    if raw_wildcards:
        return column.ilike(f"%{text}%")
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{safe}%")


def date_range(ts: Column, start: str | None, end: str | None) -> Column:
    """Inclusive days; rows without a date drop out when a bound is given."""
    ok = F.lit(True)
    if start:
        ok = ok & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end:
        ok = ok & (ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return ok


def in_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box; ``west > east`` crosses the antimeridian."""
    if not (-90 <= south <= north <= 90):
        raise ValueError("latitudes out of order or range")
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def with_any(items: DataFrame, links: DataFrame, key: str, member: str, members: Iterable) -> DataFrame:
    """Items linked to any of the members."""
    return items.join(links.where(F.col(member).isin(*members)), key, "left_semi")


def with_all(items: DataFrame, links: DataFrame, key: str, member: str, members: Iterable) -> DataFrame:
    """Items linked to all of the members (relational division over distinct members)."""
    wanted = sorted(set(members))
    found = links.where(F.col(member).isin(*wanted)).groupBy(key).agg(F.count_distinct(member).alias("n_found"))
    return items.join(found.where(F.col("n_found") == len(wanted)), key, "left_semi")


def without(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Items without a link."""
    return items.join(links, key, "left_anti")


def active(faces: DataFrame, media: DataFrame, exclusions: DataFrame, rejections: DataFrame) -> DataFrame:
    """Faces that count: live, on live present media, neither rejected nor excluded."""
    live = faces.where("deleted_at is null and review_state <> 'rejected'")
    live = live.join(media.where("deleted_at is null and missing = 0").select(F.col("id").alias("media_id")), "media_id", "left_semi")
    live = live.join(exclusions, ["person_id", "media_id"], "left_anti")
    return live.join(rejections, (live.id == rejections.face_id) & (live.person_id == rejections.person_id), "left_anti")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 100) -> DataFrame:
    """One page; numbers below 1 are the first, sizes are held within 1..200."""
    number, size = max(1, number), min(200, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def keyset(df: DataFrame, key: str, after, size: int = 100) -> DataFrame:
    """The next rows by key, without counting the ones before."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def with_reviewed(items: DataFrame, faces: DataFrame, state: str) -> DataFrame:
    """Items (id) with a live face in a review state."""
    found = faces.where(F.col("deleted_at").isNull() & (F.col("review_state") == state))
    return items.join(found.select(F.col("media_id").alias("id")), "id", "left_semi")


def with_confidence(items: DataFrame, faces: DataFrame, floor: float) -> DataFrame:
    """Items with a live face matched at least that well."""
    found = faces.where(F.col("deleted_at").isNull() & (F.col("similarity") >= floor))
    return items.join(found.select(F.col("media_id").alias("id")), "id", "left_semi")


def members(items: DataFrame, links: DataFrame, group: str | None = None, value=None) -> DataFrame:
    """Items listed in a table of members (media_id, group): of an event, an album, or all favourites."""
    found = links if group is None else links.where(F.col(group) == value)
    return items.join(found.select(F.col("media_id").alias("id")), "id", "left_semi")


def rated(items: DataFrame, edits: DataFrame, least: int) -> DataFrame:
    return items.join(edits.where(F.col("rating") >= least).select(F.col("media_id").alias("id")), "id", "left_semi")


def labelled(items: DataFrame, edits: DataFrame, label: str) -> DataFrame:
    """Items with a colour label, in any case."""
    return items.join(edits.where(F.lower("label") == label.lower()).select(F.col("media_id").alias("id")), "id", "left_semi")


def flagged(items: DataFrame, edits: DataFrame, flag: str) -> DataFrame:
    """Items flagged ``pick`` or ``reject``, or ``unflagged``: no flag, or no edits at all."""
    if flag == "unflagged":
        return items.join(edits.where("flag is not null").select(F.col("media_id").alias("id")), "id", "left_anti")
    return items.join(edits.where(F.col("flag") == flag).select(F.col("media_id").alias("id")), "id", "left_semi")


def named_or_numbered(rows: DataFrame, text: str, name: str = "name", key: str = "id") -> DataFrame:
    """Rows whose name or number holds the text."""
    return rows.where(contains(F.col(name), text, raw_wildcards=True) | contains(F.col(key).cast("string"), text, raw_wildcards=True))


# Screen sizes, and words in the names of screenshots.
SCREENS = (
    (750, 1334), (828, 1792), (1080, 1920), (1080, 2340), (1080, 2400), (1125, 2436), (1170, 2532), (1179, 2556), (1242, 2688), (1284, 2778), (1290, 2796), (1366, 768),
    (1440, 2560), (1440, 3200), (1920, 1080), (2560, 1440), (2560, 1600), (2880, 1800), (3024, 1964), (3456, 2234), (3840, 2160),
)
SHOT_WORDS = ("shot", "capture")
JOINTS = ("", " ", "-", "_")


def named_as_screenshot(name: Column) -> Column:
    """Whether a name speaks of a shot, capture or recording of a screen, or begins as a snip or a numbered capture."""
    low = F.lower(name)
    inside = F.lit(False)
    for word in SHOT_WORDS:
        for joint in JOINTS:
            inside = inside | low.contains(f"screen{joint}{word}")
    after = F.substring(low, len("capture") + 1, 2)  # a digit, with at most one joint before it
    first, second = F.substring(after, 1, 1), F.substring(after, 2, 1)
    numbered = first.between("0", "9") | (first.isin(*JOINTS[1:]) & second.between("0", "9"))
    return inside | low.contains("screen recording") | low.startswith("snip") | (low.startswith("capture") & numbered)


def screenshots(media: DataFrame) -> DataFrame:
    """Photos without a camera that are named as screenshots, or are PNGs of a screen's size, either way round."""
    shape = F.struct(F.least("width", "height").cast("int").alias("a"), F.greatest("width", "height").cast("int").alias("b"))
    sizes = F.array_distinct(F.array(*(F.struct(F.lit(min(s)).alias("a"), F.lit(max(s)).alias("b")) for s in SCREENS)))
    photo = F.col("deleted_at").isNull() & (F.col("missing") == 0) & (F.col("kind") == "photo") & F.col("camera_make").isNull() & F.col("camera_model").isNull()
    of_screen = F.lower("name").endswith(".png") & F.array_contains(sizes, shape)
    return media.where(photo & (named_as_screenshot(F.col("name")) | of_screen))


def nonface_reason(min_detection: float, min_size: float, min_quality: float) -> Column:
    """Why a face (bbox, detection, quality, landmarks, width, height) is none; null if it may be one."""
    x = F.col
    return (
        F.when(x("detection") < min_detection, "low detection score")
        .when(F.least(x("bbox")[2], x("bbox")[3]) < min_size, "too small")
        .when(F.coalesce("quality", F.lit(0.5)) < min_quality, "very low quality")
        .when(x("landmarks").isNotNull() & ~scalars.valid_landmarks(x("landmarks"), x("bbox"), x("width"), x("height")), "landmarks do not form a face")
    )


def nonfaces(faces: DataFrame, media: DataFrame, people: DataFrame, min_detection: float = 0.5, min_size: float = 20, min_quality: float = 0.2) -> DataFrame:
    """(id, person_id, reason) of faces that are hardly faces; reviewed, manual and named ones are left alone."""
    live = media.where("deleted_at is null").select(F.col("id").alias("media_id"), "width", "height")
    named = people.where("trim(coalesce(name, '')) <> ''").select(F.col("id").alias("person_id"))
    rows = faces.where("deleted_at is null and review_state = 'unreviewed' and manual = 0").join(live, "media_id").join(named, "person_id", "left_anti")
    return rows.select("id", "person_id", nonface_reason(min_detection, min_size, min_quality).alias("reason")).where("reason is not null")


def usable(faces: DataFrame, min_box: float = 24, min_detection: float = 0.65, min_quality: float = 0.35) -> DataFrame:
    """Faces good enough to tell people apart: large, sure, clear, with landmarks of a face where there are any."""
    x = F.col
    ok = (F.least(x("bbox")[2], x("bbox")[3]) >= min_box) & (x("detection") >= min_detection) & (x("quality") >= min_quality)
    return faces.where(ok & (x("landmarks").isNull() | scalars.valid_landmarks(x("landmarks"), x("bbox"), x("width"), x("height"))))


def pending(media: DataFrame, done: DataFrame, version: int, kind: str | None = None, model: str | None = None) -> DataFrame:
    """Live indexed media whose derived row (media_id, version, computed_at or model_key) is absent or old, newest id first.

    With ``model``, rows made without a model are pending too; else those made before the media was indexed.
    """
    rows = media.where("deleted_at is null and missing = 0 and status in ('indexed', 'stale')")
    rows = rows.where(F.col("kind") == kind) if kind else rows
    d = done.select(F.col("media_id").alias("id"), F.col("version").alias("_v"), F.col("model_key" if model else "computed_at").alias("_at"))
    stale = F.col("_at").isNull() if model else F.col("_at") < F.col("indexed_at")
    return rows.join(d, "id", "left").where(F.col("_v").isNull() | (F.col("_v") < version) | stale).drop("_v", "_at").orderBy(F.desc("id"))


def order(mode: str = "date") -> list[Column]:
    """Sort columns of a listing over (id, captured_at, indexed_at, size, name, position, score)."""
    taken, last = F.coalesce("captured_at", "indexed_at"), F.col("id")
    modes = {
        "date": [taken.desc(), last.desc()],
        "date_asc": [taken.asc(), last.asc()],
        "indexed": [F.desc("indexed_at"), last.desc()],
        "size_desc": [F.desc("size"), last.desc()],
        "size_asc": [F.asc("size"), last.asc()],
        "name": [F.lower("name").asc(), last.asc()],
        "album": [F.asc("position"), last.asc()],
        "best": [F.coalesce("score", F.lit(-1.0)).desc(), last.desc()],
    }
    return modes.get(mode.strip().lower(), modes["date"])


def page_and_total(df: DataFrame, by: list[Column], number: int = 1, size: int = 100) -> tuple[DataFrame, int]:
    """One page, and how many rows there are on all of them."""
    return page(df, by, number, size), df.count()
