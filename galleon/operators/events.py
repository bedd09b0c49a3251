"""Event detection: link by time and place, split by looks, fold into trips.

Links, pauses and super-sessions (no link or fold reaches over more than 36 hours) are
window columns.  What depends on order runs over Arrow columns of many users at once:
runs of linked items are cut where their looks change, and the stretches of a
super-session are folded from left to right.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import sessions, windows

# Fixed values of the semantics: hours, kilometres, speeds and shares.
LINK_HOURS, LINK_KM, LINK_KMH, FLOOR_HOURS = 4.0, 150.0, 300.0, 0.25
SPLIT_MINUTES, SPLIT_COSINE, SPLIT_ITEMS, SPLIT_SIDE = 90.0, 0.45, 4, 2
AWAY_KM, TRIP_KM, TRIP_HOURS, UNLOCATED_HOURS = 40.0, 400.0, 36.0, 18.0
PEOPLE_HOURS, PEOPLE_SHARE, PEOPLE_KM = 12.0, 0.5, 40.0
DAY = 86400


def km(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def stretches(a: int, b: int, s: np.ndarray, seen: np.ndarray, vec: np.ndarray) -> list[tuple[int, int]]:
    """Places [a, b) cut at the first long pause whose two sides look different, each side again.

    ``seen`` marks the items with a vector; a cut needs two items and two vectors on
    either side, and four vectors in all.
    """
    if b - a < SPLIT_ITEMS or seen[a:b].sum() < SPLIT_ITEMS:
        return [(a, b)]
    pauses = a + SPLIT_SIDE + np.flatnonzero(np.diff(s[a + SPLIT_SIDE - 1 : b - SPLIT_SIDE + 1]) >= SPLIT_MINUTES * 60)
    if not len(pauses):
        return [(a, b)]
    count, total = np.cumsum(seen[a:b]), np.cumsum(vec[a:b], axis=0)
    for k in pauses.tolist():
        left = count[k - a - 1]
        right = count[-1] - left
        if min(left, right) < SPLIT_SIDE:
            continue
        x, y = total[k - a - 1] / left, (total[-1] - total[k - a - 1]) / right
        if x @ y < SPLIT_COSINE * max(np.linalg.norm(x) * np.linalg.norm(y), 1e-9):
            return stretches(a, k, s, seen, vec) + stretches(k, b, s, seen, vec)
    return [(a, b)]


class Event:
    """Items so far: span, sorted coordinates (for the median place) and people."""

    def __init__(self, start: float, end: float, lat: list[float], lon: list[float], people: frozenset):
        self.start, self.end, self.people = start, end, people
        self.lat, self.lon = sorted(lat), sorted(lon)

    def centre(self) -> tuple[float, float] | None:
        n = len(self.lat)
        return ((self.lat[n // 2] + self.lat[(n - 1) // 2]) / 2, (self.lon[n // 2] + self.lon[(n - 1) // 2]) / 2) if n else None

    def take(self, other: Event) -> None:
        self.end, self.people = other.end, self.people | other.people
        if len(other.lat) > len(self.lat):
            self.lat, self.lon, other.lat, other.lon = other.lat, other.lon, self.lat, self.lon
        for mine, new in ((self.lat, other.lat), (self.lon, other.lon)):
            for x in new:
                insort(mine, x)


def joined(a: Event, b: Event, home: tuple[float, float] | None) -> bool:
    """Whether the next stretch belongs to the event so far."""
    hours = (b.start - a.end) / 3600
    if hours > TRIP_HOURS:
        return False
    p, q = a.centre(), b.centre()
    if home and p and km(p, home) > AWAY_KM:
        if q is None and hours <= UNLOCATED_HOURS:
            return True
        if q and km(q, home) > AWAY_KM and km(p, q) <= TRIP_KM:
            return True
    if not (a.people and b.people) or hours > PEOPLE_HOURS or a.start // DAY != b.start // DAY:
        return False
    share = len(a.people & b.people) / len(a.people | b.people)
    return share >= PEOPLE_SHARE and (not p or not q or km(p, q) <= PEOPLE_KM)


def home_of(items: DataFrame, by: str) -> DataFrame:
    """(by, home_lat, home_lon): the cell with most months, then days, then items; least cell on ties."""
    cell = items.where("lat is not null and lon is not null").withColumns({"a": F.bround(F.col("lat") * 20) / 20, "o": F.bround(F.col("lon") * 20) / 20, "_day": F.to_date("ts")})
    days = cell.groupBy(by, "a", "o", "_day").agg(F.count(F.lit(1)).alias("n"))
    months = days.groupBy(by, "a", "o", F.trunc("_day", "MM").alias("_month")).agg(F.count("_day").alias("days"), F.sum("n").alias("n"))
    g = months.groupBy(by, "a", "o").agg(F.count("_month").alias("months"), F.sum("days").alias("days"), F.sum("n").alias("n"))
    best = g.groupBy(by).agg(F.max(F.struct("months", "days", "n", (-F.col("a")).alias("a"), (-F.col("o")).alias("o"))).alias("x"))
    return best.select(by, (-F.col("x.a")).alias("home_lat"), (-F.col("x.o")).alias("home_lon"))


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and all of them as a matrix (zeros without)."""
    seen = column.is_valid().to_numpy().astype(bool)
    flat = pc.list_flatten(column.drop_null()).to_numpy().astype(float)
    width = len(flat) // max(1, seen.sum())
    vec = np.zeros((len(seen), width))
    vec[seen] = flat.reshape(-1, width) if width else 0
    return seen, vec


def _detect(rows: pa.Table) -> pa.Table:
    """Numbers the events of every super-session of the rows."""
    rows = rows.sort_by([(c, "ascending") for c in ("user", "super", "s", "key")])
    user, sup, s, lat, lon, linked = (rows[c].to_numpy() for c in ("user", "super", "s", "lat", "lon", "linked"))
    seen, vec = _vectors(rows["vec"])
    people = [frozenset(p or ()) for p in rows["people"].to_pylist()]
    here = ~(np.isnan(lat) | np.isnan(lon))
    home = list(zip(rows["home_lat"].to_numpy().tolist(), rows["home_lon"].to_numpy().tolist(), strict=True))
    n = len(s)
    first = np.ones(n, bool)  # of a super-session
    first[1:] = (user[1:] != user[:-1]) | (sup[1:] != sup[:-1])
    runs = np.append(np.flatnonzero(first | ~linked.astype(bool)), n)
    number, event, count = np.zeros(n, np.int64), None, 0
    start, begun = np.zeros(n, np.int64), 0  # where the row's event begins
    for i, j in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        for a, b in stretches(i, j, s, seen, vec) if j - i >= SPLIT_ITEMS else [(i, j)]:
            at = here[a:b]
            new = Event(s[a], s[b - 1], lat[a:b][at].tolist(), lon[a:b][at].tolist(), frozenset().union(*people[a:b]))
            if first[a]:
                event, count, begun = new, 1, a
            elif joined(event, new, None if math.isnan(home[a][0]) else home[a]):
                event.take(new)
            else:
                event, count, begun = new, count + 1, a
            number[a:b], start[a:b] = count, begun
    return pa.table({"user": rows["user"], "key": rows["key"], "super": rows["super"], "event": pa.array(number), "s": rows["s"], "first_s": rows["s"].take(pa.array(start)), "first_key": rows["key"].take(pa.array(start)), "old": rows["old"]})


def detect(items: DataFrame, by: str = "user_id", key: str = "event_id", rows_a_group: int = 50_000, home: DataFrame | None = None) -> DataFrame:
    """(by, key, super, event) of items (by, key, ts, lat, lon, vec, people).

    ``home`` is as from ``home_of``, where the items are not all of a user's.  Users are dealt to groups of about ``rows_a_group`` rows; one super-session is never cut.
    """
    return numbered(items.withColumn("old", F.lit(None).cast("long")), items.count(), by, key, rows_a_group, home).select(by, key, "super", "event")


def numbered(items: DataFrame, n: int, by: str, key: str, rows_a_group: int = 50_000, home: DataFrame | None = None) -> DataFrame:
    """As ``detect``, with the second of every one of the ``n`` items, the second and key of its event's first, and its column ``old``."""
    rows = sessions.sessions(items, TRIP_HOURS, by, "ts", key).withColumnRenamed("session", "super").withColumn("s", sessions.seconds(F.col("ts")))
    before = lambda c: windows.previous(c, [by], ["s", key])
    hours = (F.col("s") - before("s")) / 3600
    far = scalars.haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon"))
    near = far.isNull() | ((far <= LINK_KM) & (far / F.greatest(hours, F.lit(FLOOR_HOURS)) <= LINK_KMH))
    rows = rows.withColumn("linked", F.coalesce((hours <= LINK_HOURS) & near, F.lit(False)))
    rows = rows.join(home if home is not None else home_of(items, by), by, "left")
    real = [F.col(c).cast("double").alias(c) for c in ("lat", "lon", "home_lat", "home_lon")]
    rows = rows.select(F.col(by).alias("user"), F.col(key).alias("key"), "super", "s", "linked", *real, F.col("vec").cast("array<double>").alias("vec"), F.col("people").cast("array<long>").alias("people"), "old")
    groups = max(1, -(-n // rows_a_group))
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("user", "super"), F.lit(groups)))
    found = rows.groupBy("_g").applyInArrow(lambda t: _detect(t), "user long, key long, super long, event long, s double, first_s double, first_key long, old long")
    return found.withColumnsRenamed({"user": by, "key": key})
