"""Time and place: sessions, bursts, segments, trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows


def seconds(ts: Column) -> Column:
    """Seconds of a time without zone, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def sessions(events: DataFrame, gap_hours: float, by: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Events with ``session``: a new one after a gap longer than ``gap_hours``."""
    rows = events.withColumn("_s", seconds(F.col(ts)))
    linked = F.col("_s") - windows.previous("_s", [by], ["_s", key]) <= gap_hours * 3600
    return windows.islands(rows, [by], ["_s", key], linked, "session").drop("_s")


def bursts(events: DataFrame, gap_s: float, by: list[str], ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Chains of two or more rows, each within ``gap_s`` of the one before: by, burst, n, first, last."""
    rows = events.withColumn("_s", seconds(F.col(ts)))
    linked = F.col("_s") - windows.previous("_s", by, ["_s", key]) <= gap_s
    rows = windows.islands(rows, by, ["_s", key], linked, "burst")
    return rows.groupBy(*by, "burst").agg(F.count(F.lit(1)).alias("n"), F.min_by(key, F.struct("_s", key)).alias("first"), F.max_by(key, F.struct("_s", key)).alias("last")).where("n >= 2")


def segments(times: DataFrame, by: str, at: str, gap: float, pad: float = 1.0) -> DataFrame:
    """Padded intervals of times closer than ``gap``: by, segment, start (>= 0), end, n."""
    linked = F.col(at) - windows.previous(at, [by], [at]) <= gap
    rows = windows.islands(times, [by], [at], linked, "segment")
    out = rows.groupBy(by, "segment").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n"))
    return out.select(by, "segment", F.round(F.greatest(F.lit(0.0), F.col("lo") - pad), 2).alias("start"), F.round(F.col("hi") + pad, 2).alias("end"), "n")
