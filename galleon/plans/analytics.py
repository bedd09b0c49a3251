"""Time, vector, text, graph, evaluation and change queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import changes, graph, learning, sessions, text, vectors, windows
from ..session import table

SIM = 0.38


def q_sessions(spark, sf):
    s = sessions.sessions(table(spark, sf, "events"), 4)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


def q_trips(spark, sf):
    s = sessions.sessions(table(spark, sf, "events"), 36)
    return s.groupBy("user_id").agg(F.max("session").alias("trips"), F.count_distinct("session").alias("n"))


def q_bursts(spark, sf):
    b = sessions.bursts(table(spark, sf, "events"), 7200, ["user_id", "event_type"])
    return b.select("user_id", "event_type", "n", "first", "last")


def q_segments(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'view'").select("user_id", F.round(F.col("value") * 3, 2).alias("t")).distinct()
    return sessions.segments(e, "user_id", "t", 6.0)


def q_on_this_day(spark, sf):
    o = table(spark, sf, "orders").where((F.date_format("o_orderdate", "MM-dd") == "06-15") & (F.year("o_orderdate") < 1998))
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def q_exact_duplicates(spark, sf):
    return graph.exact_groups(table(spark, sf, "documents"), "text", "doc_id", [F.col("n_chars"), -F.col("doc_id")])


def _vector(spark, sf, i):
    return table(spark, sf, "embeddings").where(F.col("vec_id") == i).first()["embedding"]


def q_knn_exact(spark, sf):
    n = vectors.nearest(table(spark, sf, "embeddings").where("vec_id <> 0"), _vector(spark, sf, 0), 20)
    return n.select("vec_id", F.round("similarity", 6).alias("similarity"))


def q_knn_filtered(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id <> 0 and label in (1, 4, 7)")
    return vectors.nearest(e, _vector(spark, sf, 0), 20).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def q_best_per_label(spark, sf):
    q = F.array(*map(F.lit, map(float, _vector(spark, sf, 0))))
    e = table(spark, sf, "embeddings").where("vec_id <> 0").withColumn("s", vectors.cosine(F.col("embedding"), q))
    return e.groupBy("label").agg(F.round(F.max("s"), 6).alias("similarity"), F.count(F.lit(1)).alias("n"))


def q_knn_join_all(spark, sf):
    """The five nearest others of every vector."""
    e = table(spark, sf, "embeddings")
    return vectors.top_k_join(e, e, 5).select("a", "b", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def q_similarity_join(spark, sf):
    p = vectors.similarity_join(table(spark, sf, "embeddings"), SIM)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


def q_near_groups(spark, sf):
    return graph.near_groups(vectors.similarity_join(table(spark, sf, "embeddings"), 0.42))


def q_components_all(spark, sf):
    """Components of orders and suppliers (as negative ids, which no order has) over all line items."""
    return graph.components(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")))


def q_centroids(spark, sf):
    return vectors.centroids(table(spark, sf, "embeddings"), "label", F.greatest(F.lit(0.15), (F.col("vec_id") % 10) / 10.0), digits=5)


def q_unit_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.size(vectors.unit(F.col("embedding"))).cast("long").alias("dim"))


def q_loo_eval(spark, sf):
    r = vectors.leave_one_out(table(spark, sf, "embeddings"), "label", 0.1)
    return r.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("own"), 3).alias("own"))


def q_threshold_sweep(spark, sf):
    d, la = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = d.join(la, "doc_id").select(X.scaled_round(F.least(F.lit(1.0), F.col("n_chars") / 2000), 2).alias("s"), F.col("quality").alias("y"))
    c = learning.sweep(rows.select(F.col("s").alias("similarity"), F.col("y").alias("correct")))
    return c.select(F.col("t").alias("s"), "tp", *(X.scaled_round(F.col(x), 6).alias(y) for x, y in (("precision", "precision"), ("recall", "recall"), ("f", "f_half"))))


WEIGHTS = {"knn": 1.0, "recent": 0.3, "text": 0.8}


def q_rrf(spark, sf):
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").where("lang = 'en'")
    alive = d.select(F.col("doc_id").alias("id"))
    knn = vectors.nearest(e.where("vec_id <> 0").join(alive, e.vec_id == alive.id, "left_semi"), _vector(spark, sf, 0), 100)
    knn = knn.select(F.lit("knn").alias("signal"), F.col("vec_id").alias("id"), F.round("similarity", 9).alias("value"))
    recent = d.orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(100).select(F.lit("recent").alias("signal"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("value"))
    ranked = text.bm25(d, ["worthless", "the", "pathetic"]).orderBy(F.desc(F.round("score", 9)), F.desc("doc_id")).limit(100)
    words = ranked.select(F.lit("text").alias("signal"), F.col("doc_id").alias("id"), F.round("score", 9).alias("value"))
    w = Window.partitionBy("signal").orderBy(F.desc("value"), F.desc("id"))
    signals = knn.unionByName(recent).unionByName(words).withColumn("rank", F.row_number().over(w))
    fused = vectors.rrf(signals, WEIGHTS)
    return fused.orderBy(F.desc(F.round("score", 9)), F.desc("id")).limit(50).select("id", F.round("score", 9).alias("score"), "n_signals")


def q_bm25(spark, sf):
    s = text.bm25(table(spark, sf, "documents"), ["idiot", "clown", "the"]).withColumn("score", F.round("score", 6))
    return s.orderBy(F.desc("score"), "doc_id").limit(50)


def q_hamming(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 16).alias("h"), F.substring(F.sha2("text", 256), 17, 16).alias("g"))
    return b.select("item_id", X.hamming64(F.col("h"), F.col("g")).cast("long").alias("bits"))


def q_filename_date(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("IMG_"), (1995 + F.col("doc_id") % 30).cast("string"), F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0"), F.lpad((F.col("doc_id") % 33).cast("string"), 2, "0"), F.lit("_"), F.lpad((F.col("doc_id") % 26).cast("string"), 2, "0"), F.lit("3015.jpg"))
    return d.select("doc_id", F.date_format(X.date_in_name(name), "yyyy-MM-dd HH:mm:ss").alias("taken"))


def q_composite_score(spark, sf):
    li = table(spark, sf, "lineitem")
    part = lambda c, top, none: F.nullif(F.col(c), F.lit(none)) / top
    score = X.weighted_mean({"sharp": (part("l_quantity", 50, 7.0), 0.28), "light": (part("l_discount", 0.1, 0.0), 0.14), "noise": (part("l_tax", 0.08, 0.0), 0.10)})
    return li.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


def q_confidence(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value") / 100).alias("s"))
    return e.groupBy(X.confidence(F.col("s"), 0.6).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def q_haversine(spark, sf):
    c = table(spark, sf, "customer")
    far = X.haversine_km(F.col("c_custkey") % 180 - 90.0, F.col("c_acctbal") % 180, F.lit(48.8566), F.lit(2.3522))
    return c.select("c_custkey", F.round(far, 4).alias("km"))


def q_iou(spark, sf):
    li = table(spark, sf, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.array(F.col("l_partkey") % 50 * 1.0, F.col("l_suppkey") % 50 * 1.0, F.col("l_quantity"), F.col("l_quantity") + 3).alias("b"))
    a, b = li.where("l_linenumber = 1").select("l_orderkey", F.col("b").alias("x")), li.where("l_linenumber = 2").select("l_orderkey", F.col("b").alias("y"))
    return a.join(b, "l_orderkey").select("l_orderkey", F.round(X.iou(F.col("x"), F.col("y")), 6).alias("iou"))


def q_display_name(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.col("c_name")))
    return c.select("c_custkey", X.display_name(name, F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey"))).alias("name"))


def q_fts_tokens(spark, sf):
    d = table(spark, sf, "benchmark")
    return d.select("item_id", F.array_join(X.fts_tokens(F.regexp_replace("text", "[^a-zA-Z ]", " ")), " ").alias("tokens"))


def q_tags(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.tags(F.col("text"), ("the", "and", "for")), ",").alias("tags"))


def q_scan_diff(spark, sf):
    o = table(spark, sf, "orders")
    known = o.where("o_orderkey % 10 <> 3").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files = o.where("o_orderkey % 10 <> 7").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    known = known.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return changes.scan_diff(known, files, "o_orderkey", ["o_totalprice", "o_orderstatus"])


def q_cdc_latest_all(spark, sf):
    journal = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("value").alias("v"), F.col("event_id").alias("seq"), "event_type")
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    return changes.apply_changes(base, journal, "key", "seq", F.col("event_type") == "purchase")


def q_audit_state(spark, sf):
    return changes.audit_state(table(spark, sf, "events"), "user_id", "event_id", "event_type")


def _merge(policy):
    def run(spark, sf):
        c = table(spark, sf, "customer")
        mine = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
        theirs = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
        return changes.merge(mine, theirs, "key", policy)

    return run


def q_json_props(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").cast("long").alias("k"))


def q_url_parts(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1).alias("path"))


def q_album_append(spark, sf):
    li = table(spark, sf, "lineitem")
    album = li.where("l_linenumber <= 2").select((F.col("l_suppkey") % 10).alias("album_id"), F.col("l_orderkey").alias("media_id")).distinct().withColumn("position", F.row_number().over(Window.partitionBy("album_id").orderBy("media_id")).cast("long"))
    items = li.where("l_linenumber = 3").select((F.col("l_suppkey") % 10).alias("album_id"), F.col("l_orderkey").alias("media_id"), F.col("l_partkey").alias("ord"))
    return changes.append_to_album(album, items)


def q_remap(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    mapping = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 1).alias("new"))
    return changes.remap(o, mapping, "o_custkey")


def q_queue_merge(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("dedupe_key"), F.col("event_id").alias("seq"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("path"), (F.col("event_id") % 5).alias("priority"))
    return changes.queue_merge(e).select("dedupe_key", F.array_join("paths", ",").alias("paths"), "priority", "merged")


def q_recover(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "running").otherwise("done").alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"))
    r = changes.recover(e)
    return r.groupBy("status", F.col("attempts").cast("long").alias("attempts")).agg(F.count(F.lit(1)).alias("n"))


def q_memories(spark, sf):
    o = table(spark, sf, "orders").withColumn("md", F.date_format("o_orderdate", "MM-dd"))
    g = o.groupBy("md").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.year("o_orderdate")).alias("years"))
    return g.where("years >= 2")


def q_label_max(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    return e.groupBy("user_id").agg(F.max("value").alias("score"))


def q_people_in_selection_all(spark, sf):
    """The selection is the orders with a returned line: it grows with the table."""
    li = table(spark, sf, "lineitem")
    li = li.join(li.where("l_returnflag = 'R'").select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    return li.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("media"), F.min("l_partkey").alias("face"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("kinds"))


def q_median_centre(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("lat"), F.round(F.median(F.col("event_id") % 360), 6).alias("lon"))


DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
BM25 = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\w'']+)', 1) AS w FROM {docs}),
c AS (SELECT doc_id, len(w) AS len, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM c),
bm AS (SELECT doc_id, {score} AS score FROM c, s WHERE {hit})"""


def _bm25_sql(docs: str, tokens: list[str]) -> str:
    k = range(len(tokens))
    return BM25.format(
        docs=docs,
        tf=", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(tokens)),
        df=", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in k),
        score=" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in k),
        hit=" OR ".join(f"tf{i} > 0" for i in k),
    )


SESS = "SELECT *, sum(CASE WHEN epoch_us(ts) - p <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"
MERGE = "WITH m AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0), t AS (SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 0) "

QUERIES = {
    "q_sessions": (q_sessions, "SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS least FROM (" + SESS.format(gap=4 * 3600 * 10**6) + ") GROUP BY 1, 2"),
    "q_trips": (q_trips, "SELECT user_id, max(session)::BIGINT AS trips, count(DISTINCT session) AS n FROM (" + SESS.format(gap=36 * 3600 * 10**6) + ") GROUP BY 1"),
    "q_bursts": (q_bursts, "SELECT user_id, event_type, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM (SELECT *, sum(CASE WHEN epoch_us(ts) - p <= 7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, event_type, g HAVING count(*) >= 2"),
    "q_person_segments": (q_segments, "SELECT user_id, g::BIGINT AS segment, round(greatest(0, min(t) - 1), 2) AS start, round(max(t) + 1, 2) AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE WHEN t - p <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM (SELECT DISTINCT user_id, round(value * 3, 2) AS t FROM events WHERE event_type = 'view'))) GROUP BY user_id, g"),
    "q_on_this_day": (q_on_this_day, "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%m-%d') = '06-15' AND year(o_orderdate) < 1998 GROUP BY 1"),
    "q_exact_duplicates": (q_exact_duplicates, "SELECT sha256(text) AS hash, count(*) AS size, arg_max(doc_id, (n_chars, -doc_id)) AS keep, (sum(strlen(text)) - max(strlen(text)))::BIGINT AS saved FROM documents GROUP BY 1 HAVING count(*) >= 2"),
    "q_knn_exact": (q_knn_exact, f"SELECT a.vec_id, round({DOT}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0 ORDER BY {DOT} DESC, a.vec_id LIMIT 20"),
    "q_knn_filtered": (q_knn_filtered, f"SELECT a.vec_id, a.label, round({DOT}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0 AND a.label IN (1, 4, 7) ORDER BY {DOT} DESC, a.vec_id LIMIT 20"),
    "q_best_per_label": (q_best_per_label, f"SELECT a.label, round(max({DOT}), 6) AS similarity, count(*) AS n FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0 GROUP BY 1"),
    "q_knn_join_all": (q_knn_join_all, None),
    "q_similarity_join": (q_similarity_join, f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {DOT} >= {SIM}"),
    "q_near_groups": (q_near_groups, f"WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {DOT} >= 0.42), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS node FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.node), c AS (SELECT id, min(node) AS component FROM r GROUP BY 1) SELECT 'near-' || x.component AS key, x.size, y.similarity FROM (SELECT component, count(*) AS size FROM c GROUP BY 1) x JOIN (SELECT component, round(max(s), 6) AS similarity FROM p JOIN c ON p.a = c.id GROUP BY 1) y USING (component)"),
    "q_components_all": (q_components_all, None),
    "q_centroids": (q_centroids, "WITH u AS (SELECT label, greatest(0.15, (vec_id % 10) / 10.0) AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), s AS (SELECT label, pos, sum(w * x) AS wx, sum(x) AS x, count(*) AS n FROM u GROUP BY 1, 2), g AS (SELECT label, max(n) AS members, list(wx ORDER BY pos) AS c, list(x ORDER BY pos) AS p, sqrt(sum(wx * wx)) AS len FROM s GROUP BY 1) SELECT label, members, list_transform(c, lambda v: round(v / len, 5)) AS centroid, round(greatest(0, 1 - list_dot_product(c, p) / len / members), 5) AS variance FROM g"),
    "q_unit_vectors": (q_unit_vectors, "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding) AS dim FROM embeddings"),
    "q_loo_eval": (q_loo_eval, None),
    "q_threshold_sweep": (q_threshold_sweep, "WITH r AS (SELECT round(least(1.0, n_chars / 2000), 2) AS s, quality AS y FROM documents JOIN labels USING (doc_id)), b AS (SELECT s, sum(y) AS pos, count(*) AS n FROM r GROUP BY 1), c AS (SELECT s, sum(pos) OVER w AS tp, sum(n) OVER w AS said, (SELECT sum(y) FROM r) AS a FROM b WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT s, tp::BIGINT AS tp, round(tp / said, 6) AS precision, round(tp / a, 6) AS recall, round(CASE WHEN tp > 0 THEN 1.25 * (tp / said) * (tp / a) / (0.25 * (tp / said) + tp / a) ELSE 0 END, 6) AS f_half FROM c WHERE s BETWEEN 0.3 AND 0.8"),
    "q_rrf": (q_rrf, "WITH d AS (SELECT * FROM documents WHERE lang = 'en'), " + _bm25_sql("d", ["worthless", "the", "pathetic"]) + f", k AS (SELECT 'knn' AS signal, a.vec_id AS id, round({DOT}, 9) AS value FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0 AND a.vec_id IN (SELECT doc_id FROM d) ORDER BY {DOT} DESC, a.vec_id LIMIT 100), r AS (SELECT 'recent' AS signal, doc_id AS id, n_chars::DOUBLE AS value FROM d ORDER BY n_chars DESC, doc_id DESC LIMIT 100), x AS (SELECT 'text' AS signal, doc_id AS id, round(score, 9) AS value FROM bm ORDER BY round(score, 9) DESC, doc_id DESC LIMIT 100), a AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY value DESC, id DESC) AS rank FROM (SELECT * FROM k UNION ALL SELECT * FROM r UNION ALL SELECT * FROM x)) SELECT id, round(sum(CASE signal WHEN 'knn' THEN 1.0 WHEN 'recent' THEN 0.3 ELSE 0.8 END / (60 + rank)), 9) AS score, count(*) AS n_signals FROM a GROUP BY id ORDER BY score DESC, id DESC LIMIT 50"),
    "q_bm25": (q_bm25, "WITH " + _bm25_sql("documents", ["idiot", "clown", "the"]) + " SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 50"),
    "q_hamming": (q_hamming, "SELECT item_id, bit_count(xor(('0x' || substr(sha256(text), 1, 8))::BIGINT, ('0x' || substr(sha256(text), 17, 8))::BIGINT)) + bit_count(xor(('0x' || substr(sha256(text), 9, 8))::BIGINT, ('0x' || substr(sha256(text), 25, 8))::BIGINT)) AS bits FROM benchmark"),
    "q_filename_date": (q_filename_date, "WITH n AS (SELECT doc_id, 'IMG_' || (1995 + doc_id % 30) || lpad((doc_id % 14)::VARCHAR, 2, '0') || lpad((doc_id % 33)::VARCHAR, 2, '0') || '_' || lpad((doc_id % 26)::VARCHAR, 2, '0') || '3015' AS name FROM documents) SELECT doc_id, CASE WHEN doc_id % 14 BETWEEN 1 AND 12 AND doc_id % 33 BETWEEN 1 AND 31 THEN strftime(try_strptime(CASE WHEN doc_id % 26 <= 23 THEN substr(name, 5) ELSE substr(name, 5, 9) || '120000' END, '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') END AS taken FROM n"),
    "q_composite_score": (q_composite_score, "SELECT l_orderkey, l_linenumber, round(CASE WHEN w > 0 THEN v / w END, 6) AS score FROM (SELECT *, CASE WHEN l_quantity <> 7 THEN 0.28 ELSE 0 END + CASE WHEN l_discount <> 0 THEN 0.14 ELSE 0 END + CASE WHEN l_tax <> 0 THEN 0.1 ELSE 0 END AS w, CASE WHEN l_quantity <> 7 THEN l_quantity / 50 * 0.28 ELSE 0 END + l_discount / 0.1 * 0.14 + l_tax / 0.08 * 0.1 AS v FROM lineitem)"),
    "q_confidence": (q_confidence, "SELECT CASE WHEN event_id % 11 = 0 OR value IS NULL THEN 'unknown' WHEN value / 100 >= 0.6 THEN 'high' WHEN value / 100 >= 0.48 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM events GROUP BY 1"),
    "q_haversine": (q_haversine, "SELECT c_custkey, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(48.8566) - radians(c_custkey % 180 - 90.0)) / 2), 2) + cos(radians(c_custkey % 180 - 90.0)) * cos(radians(48.8566)) * pow(sin(radians(2.3522 - c_acctbal % 180) / 2), 2)))), 4) AS km FROM customer"),
    "q_iou": (q_iou, "WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y, l_quantity AS w, l_quantity + 3 AS h FROM lineitem), j AS (SELECT a.l_orderkey, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS t FROM b a JOIN b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2) SELECT l_orderkey, round(i / (t - i), 6) AS iou FROM j"),
    "q_display_name": (q_display_name, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 5 <> 0 THEN 'Person ' || c_custkey ELSE 'Unknown' END AS name FROM customer"),
    "q_fts_tokens": (q_fts_tokens, r"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^a-zA-Z ]', ' ', 'g')), '([\w'']+)', 1), lambda x: len(x) > 2)[1:8], ' ') AS tokens FROM benchmark"),
    "q_tags": (q_tags, "SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:8], ',') AS tags FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '([a-z]{3,})', 1), lambda x: x NOT IN ('the', 'and', 'for')) AS w FROM benchmark)"),
    "q_scan_diff": (q_scan_diff, "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'new' WHEN o_orderkey % 10 = 7 THEN 'gone' WHEN o_orderkey % 4 = 1 THEN 'changed' ELSE 'same' END AS change FROM orders"),
    "q_cdc_latest_all": (q_cdc_latest_all, "WITH l AS (SELECT user_id AS key, value AS v, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1) SELECT c_custkey AS key, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT key FROM l) UNION ALL SELECT key, v FROM l WHERE event_type <> 'purchase'"),
    "q_audit_state": (q_audit_state, "SELECT user_id, arg_max(event_type, event_id) AS action, count(*) AS entries FROM events GROUP BY 1"),
    "q_merge_keep_both": (_merge("keep_both"), MERGE + "SELECT *, 'mine' AS origin FROM m UNION ALL SELECT *, 'theirs' FROM t"),
    "q_merge_skip": (_merge("skip"), MERGE + "SELECT *, 'mine' AS origin FROM m UNION ALL SELECT *, 'theirs' FROM t WHERE key NOT IN (SELECT key FROM m)"),
    "q_merge_overwrite": (_merge("overwrite"), MERGE + "SELECT *, 'theirs' AS origin FROM t UNION ALL SELECT *, 'mine' FROM m WHERE key NOT IN (SELECT key FROM t)"),
    "q_json_props": (q_json_props, "SELECT event_id, (props->>'k')::BIGINT AS k FROM events"),
    "q_url_parts": (q_url_parts, "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages"),
    "q_album_append": (q_album_append, "WITH a AS (SELECT album_id, media_id, row_number() OVER (PARTITION BY album_id ORDER BY media_id) AS position FROM (SELECT DISTINCT l_suppkey % 10 AS album_id, l_orderkey AS media_id FROM lineitem WHERE l_linenumber <= 2)), f AS (SELECT l_suppkey % 10 AS album_id, l_orderkey AS media_id, min(l_partkey) AS ord FROM lineitem WHERE l_linenumber = 3 AND (l_suppkey % 10, l_orderkey) NOT IN (SELECT (album_id, media_id) FROM a) GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT album_id, media_id, coalesce((SELECT max(position) FROM a WHERE a.album_id = f.album_id), 0) + row_number() OVER (PARTITION BY album_id ORDER BY ord, media_id) FROM f"),
    "q_remap": (q_remap, "SELECT DISTINCT CASE WHEN c_custkey IS NOT NULL THEN o_custkey - 1 ELSE o_custkey END AS o_custkey, o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 = 0"),
    "q_queue_merge": (q_queue_merge, "SELECT dedupe_key, string_agg(path, ',' ORDER BY seq) AS paths, min(priority) AS priority, sum(k)::BIGINT AS merged FROM (SELECT user_id || ':' || event_type AS dedupe_key, 'p' || (event_id % 7) AS path, min(event_id) AS seq, min(event_id % 5) AS priority, count(*) AS k FROM events GROUP BY 1, 2) GROUP BY 1"),
    "q_recover": (q_recover, "SELECT status, attempts, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 <> 0 THEN 'done' WHEN event_id % 4 + 1 >= 3 THEN 'failed' ELSE 'queued' END AS status, event_id % 4 + (event_id % 3 = 0)::INT AS attempts FROM events) GROUP BY 1, 2"),
    "q_memories": (q_memories, "SELECT strftime(o_orderdate, '%m-%d') AS md, count(*) AS n, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) >= 2"),
    "q_label_max": (q_label_max, "SELECT user_id, max(value) AS score FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"),
    "q_people_in_selection_all": (q_people_in_selection_all, "SELECT l_suppkey, count(DISTINCT l_orderkey) AS media, min(l_partkey) AS face, array_to_string(list_sort(list(DISTINCT l_returnflag)), '') AS kinds FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1"),
    "q_median_centre": (q_median_centre, "SELECT user_id, round(median(value), 6) AS lat, round(median(event_id % 360), 6) AS lon FROM events GROUP BY 1"),
}
