"""Order-dependent and streaming queries; SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ann, crops, events, sequences, vectors
from ..session import shared_folder, table
from ..sources import files
from ..streaming import incremental
from .analytics import DOT


def _items(spark, sf):
    e = table(spark, sf, "events")
    vec = F.array(F.cos(F.col("value")), F.sin(F.col("value")))
    lat = F.when(F.col("event_id") % 4 != 0, 48 + F.col("user_id") % 5 + F.col("value") / 50)
    lon = F.when(F.col("event_id") % 4 != 0, 2 + F.col("value") / 30)
    return e.select("user_id", "event_id", "ts", lat.alias("lat"), lon.alias("lon"), vec.alias("vec"), F.array(F.col("event_id") % 3).alias("people"))


def q_events_full(spark, sf):
    found = events.detect(_items(spark, sf))
    return found.groupBy("user_id", "super", "event").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


def q_home(spark, sf):
    h = events.home_of(_items(spark, sf), "user_id")
    return h.select("user_id", F.round("home_lat", 4).alias("home_lat"), F.round("home_lon", 4).alias("home_lon"))


def _detections(spark, sf):
    li = table(spark, sf, "lineitem")
    vec = F.array(*(F.sin(F.col("l_suppkey") * (i + 1)) for i in range(4)))
    box = F.array(F.col("l_suppkey") % 40 * 1.0, F.col("l_linenumber") * 1.0, F.lit(20.0), F.lit(20.0))
    return li.select((F.col("l_orderkey") % 200).cast("long").alias("media_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") / 200).cast("int").cast("double").alias("ts"), box.alias("bbox"), vec.alias("vec"), (0.4 + F.col("l_quantity") / 100).alias("detection"), F.col("l_discount").alias("quality"))


def q_tracking(spark, sf):
    t = sequences.track(_detections(spark, sf))
    return t.groupBy("media_id").agg(F.count_distinct("track").alias("tracks"), F.count(F.lit(1)).alias("n"))


def q_suppress(spark, sf):
    return sequences.suppress(_detections(spark, sf), "media_id").groupBy("media_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("covered").alias("covered"))


def q_mmr(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("rank"), (F.col("vec_id") % 10 / 10.0).alias("score"), F.col("embedding").alias("vec"), F.lit("d").alias("day"))
    return sequences.diverse(e, 24)


def q_timeline_sections(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.timeline_sections(o)


def q_export_names(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.concat(F.lit("IMG_"), (F.col("doc_id") % 9).cast("string"), F.lit(".jpg")).alias("name"))
    return files.export_names(d, "doc_id", ["lang", "source"], "name")


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def q_stream_windows(spark, sf):
    at = _scratch(spark)
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = e.agg(F.lit(-1).cast("long").alias("event_id"), F.to_timestamp(F.lit("2031-01-01 00:00:00")).alias("ts"), F.lit("end").alias("event_type"))
    e.write.parquet(f"{at}/in/a")
    last.write.parquet(f"{at}/in/b")  # moves the watermark past every window
    s = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    out = incremental.collect_once(incremental.windowed_counts(s, "6 hours", "60 days", "event_type"), f"{at}/out", f"{at}/cp")
    return out.where("event_type <> 'end'").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def q_stream_journal(spark, sf):
    at = _scratch(spark)
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("value").alias("v"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("deleted"))
    e.write.parquet(f"{at}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{at}/in")
    incremental.apply_journal_buckets(s, base, f"{at}/table", f"{at}/cp", "key", "seq").awaitTermination()
    return incremental.read_buckets(spark, f"{at}/table", base.columns)


def q_ann(spark, sf):
    """Neighbours of every 20th vector from inverted lists, at a recall of 0.95 on a sample of the queries."""
    e = table(spark, sf, "embeddings")
    queries, index = e.where("vec_id % 20 = 0"), ann.build(e)
    found = ann.search(index, queries, 10, ann.tune(index, queries, e, 10))
    return found.select("a", "b", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def q_join_in_lists(spark, sf):
    p = ann.similarity_join(table(spark, sf, "embeddings"), 0.42)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


def q_keyframes(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e9).alias("t"), (F.col("value") / 100).alias("scene"))
    return crops.keyframes(e).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))


def q_redetections(spark, sf):
    d = _detections(spark, sf).select("media_id", "id", F.col("ts").alias("timestamp"), "bbox", vectors.unit(F.col("vec")).alias("embedding"))
    found = crops.redetections(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.5)
    return found.groupBy("media_id").agg(F.count("old_id").alias("known"), F.count(F.lit(1)).alias("n"))


def q_auto_identity(spark, sf):
    """Vectors of one label stand for the crops of ten people each."""
    e = table(spark, sf, "embeddings")
    person = (F.col("label") * 10 + F.col("vec_id") % 10).cast("long")
    c = e.select(person.alias("person_id"), F.col("vec_id").alias("face_id"), F.col("vec_id").alias("media_id"), F.lit(None).cast("double").alias("timestamp"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(40.0).alias("size"), "embedding", (0.4 + F.col("vec_id") % 50 / 100).alias("quality"))
    p = c.groupBy(F.col("person_id").alias("id")).agg(F.count(F.lit(1)).alias("face_count")).withColumn("name", F.lit(None).cast("string"))
    none = p.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return crops.auto_identity(c, p, c.select("person_id", "media_id", "timestamp"), none, floors=(0.42, 0.3, 0.1))


def q_distinct_crops(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("person_id"), F.col("vec_id").alias("face_id"), vectors.unit(F.col("embedding")).alias("embedding"), (F.col("vec_id") % 10 / 10).alias("quality"))
    return crops.distinct_crops(e, 32, 0.3)


QUERIES = {
    "q_events_full": (q_events_full, None),
    "q_event_home": (q_home, "WITH i AS (SELECT user_id, ts, 48 + user_id % 5 + value / 50 AS lat, 2 + value / 30 AS lon FROM events WHERE event_id % 4 <> 0), g AS (SELECT user_id, round_even(lat * 20, 0) / 20 AS a, round_even(lon * 20, 0) / 20 AS o, count(DISTINCT strftime(ts, '%Y-%m')) AS m, count(DISTINCT ts::DATE) AS d, count(*) AS n FROM i GROUP BY 1, 2, 3) SELECT user_id, round(a, 4) AS home_lat, round(o, 4) AS home_lon FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, d DESC, n DESC, a, o) AS r FROM g) WHERE r = 1"),
    "q_tracking": (q_tracking, None),
    "q_suppress": (q_suppress, None),
    "q_mmr": (q_mmr, None),
    "q_timeline_sections": (q_timeline_sections, None),
    "q_ann": (q_ann, None),
    "q_join_in_lists": (q_join_in_lists, "SELECT a.vec_id AS a, b.vec_id AS b, round(" + DOT + ", 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND " + DOT + " >= 0.42"),
    "q_keyframes": (q_keyframes, None),
    "q_redetections": (q_redetections, None),
    "q_auto_identity": (q_auto_identity, None),
    "q_distinct_crops": (q_distinct_crops, None),
    "q_export_names": (q_export_names, "SELECT doc_id, lang || '/' || source || '/IMG_' || (doc_id % 9) || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END || '.jpg' AS path FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, doc_id % 9 ORDER BY doc_id) AS r FROM documents)"),
    "q_stream_windows": (q_stream_windows, "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "q_stream_journal": (q_stream_journal, "WITH l AS (SELECT user_id AS key, value AS v, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1) SELECT c_custkey AS key, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT key FROM l) UNION ALL SELECT key, v FROM l WHERE event_type <> 'purchase'"),
}
