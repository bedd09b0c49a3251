"""Filtered and grouped vector searches, camera dates, file identities and checks of stored lists, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import ann, crops, integrity, library
from ..session import table
from .analytics import DOT
from .analytics import QUERIES as ANALYTICS


def _first(e):
    """The vector that stands for a query."""
    return [float(x) for x in e.where("vec_id = 0").first()["embedding"]]


def q_ann_filtered(spark, sf):
    """q_knn_filtered over inverted lists: the 20 nearest of three labels."""
    e = table(spark, sf, "embeddings")
    allowed = e.where("label in (1, 4, 7) and vec_id <> 0")
    found = ann.filtered(ann.build(e), e, allowed, _first(e), 20)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity")).join(e.select("vec_id", "label"), "vec_id")


def q_video_moments(spark, sf):
    """The 40 keyframes most like a query, three of a video at most."""
    e = table(spark, sf, "embeddings")
    frames = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 40).alias("media_id"), (F.col("vec_id") / 8.0).alias("t"), "embedding")
    return crops.video_moments(frames, _first(e))


MOMENTS = f"""WITH s AS (SELECT a.vec_id AS id, a.vec_id % 40 AS media_id, a.vec_id / 8.0 AS t, {DOT} AS s FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY s DESC, id LIMIT 2000),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s DESC, id) AS n FROM s)
SELECT id, media_id, round(t, 2) AS t, round(s, 4) AS similarity FROM r WHERE n <= 3 ORDER BY s DESC, id LIMIT 40"""


def q_exif_dates(spark, sf):
    """Order dates as cameras write them: colons, dashes, a day alone, or zeros."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    shaped = F.when(k % 4 == 0, F.date_format(d, "yyyy:MM:dd HH:mm:ss")).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 2, F.date_format(d, "yyyy:MM:dd")).otherwise("0000:00:00 00:00:00")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(X.exif_date(shaped), "yyyy-MM-dd HH:mm:ss").alias("taken"))


def q_relative_identity(spark, sf):
    """Documents as files of a share that two machines name differently; every fifth lies elsewhere."""
    i = F.col("doc_id")
    root = F.when(i % 2 == 0, F.lit("//Server/Photos/")).otherwise(F.lit("\\\\SERVER\\Photos"))
    at = F.when(i % 5 == 0, F.lit("//other/Photos/")).when(i % 2 == 0, F.lit("//Server/Photos/")).otherwise(F.lit("\\\\server\\photos\\"))
    path = F.concat(at, F.initcap("source"), F.lit(". /IMG_"), i.cast("string"), F.lit(".JPG"))
    return table(spark, sf, "documents").select("doc_id", X.relative_identity(root, path).alias("identity"))


def q_stale_vectors(spark, sf):
    """Vectors that stay after every fifth customer's content has changed."""
    c = table(spark, sf, "customer")
    hashed = lambda changed: c.select(F.col("c_custkey").alias("id"), F.sha2(F.concat("c_name", F.when(F.lit(changed) & (F.col("c_custkey") % 5 == 0), F.lit("+")).otherwise("")), 256).alias("content_hash"))
    return library.stale_vectors(c.select(F.col("c_custkey").alias("key")), hashed(True), hashed(False))


def q_result_overlap(spark, sf):
    """Sizes of two lists of documents and of what they share."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return integrity.overlap(d.where("n_chars > 1000"), d.where("lang = 'en'"))


QUERIES = {
    "q_ann_filtered": (q_ann_filtered, ANALYTICS["q_knn_filtered"][1]),
    "q_video_moments": (q_video_moments, MOMENTS),
    "q_exif_dates": (q_exif_dates, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS taken FROM (SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1990 THEN o_orderdate END AS o_orderdate FROM orders)"),
    "q_relative_identity": (q_relative_identity, "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lower(source) || '/img_' || doc_id || '.jpg' END AS identity FROM documents"),
    "q_stale_vectors": (q_stale_vectors, "SELECT c_custkey AS key FROM customer WHERE c_custkey % 5 <> 0"),
    "q_result_overlap": (q_result_overlap, "SELECT count(*) FILTER (n_chars > 1000) AS a, count(*) FILTER (lang = 'en') AS b, count(*) FILTER (n_chars > 1000 AND lang = 'en') AS \"both\" FROM documents"),
}
