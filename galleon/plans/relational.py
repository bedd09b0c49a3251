"""Facets, joins, aggregates, windows and set operations as registered queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import facets, windows
from ..session import table


def facet_filter_page(spark, sf):
    d = table(spark, sf, "documents").where((F.col("lang") == "en") & F.col("n_chars").between(200, 20_000) & (facets.contains(F.col("text"), "TH_e") | facets.contains(F.col("text"), "the ")))
    return facets.page(d.select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), F.desc("doc_id")], 2, 50)


def date_facet(spark, sf):
    e = table(spark, sf, "events").where(facets.date_range(F.col("ts"), "2024-01-05", "2024-01-06") & F.col("event_type").isNotNull())
    return e.select("event_id", "user_id", "event_type")


PARTS = (1, 3, 7, 20, 55)


def people_any(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return facets.with_any(o, li, "o_orderkey", "l_partkey", PARTS).select("o_orderkey", "o_custkey")


def people_all(spark, sf):
    e = table(spark, sf, "events")
    users = e.select("user_id").distinct()
    types = e.where("value > 60").select("user_id", "event_type")
    kinds = ("click", "view", "purchase", "click")
    return facets.with_all(users, types, "user_id", "event_type", kinds)


def exclude_people(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_partkey <= 100").select(F.col("l_orderkey").alias("o_orderkey"))
    return facets.without(o, li, "o_orderkey").select("o_orderkey", "o_orderstatus")


def no_faces(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return facets.without(c, o, "c_custkey").select("c_custkey", "c_name")


def min_quality(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


def bbox_antimeridian(spark, sf):
    c = table(spark, sf, "customer")
    lat, lon = F.col("c_custkey") % 180 - 90, F.col("c_acctbal") % 180
    return c.where(facets.in_bbox(lat, lon, -40, 150, 60, -20)).select("c_custkey", "c_acctbal")


def orphans(spark, sf):
    la, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    return d.join(la, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("problem")).unionByName(
        la.join(d, "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("problem"))
    )


def screenshots(spark, sf):
    d = table(spark, sf, "documents")
    shape = F.struct((F.col("doc_id") % 4).cast("int").alias("w"), (F.col("n_chars") % 3).cast("int").alias("h"))
    listed = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in ((1, 2), (2, 1), (3, 0))))
    return d.where(F.col("text").rlike("(?i)^(the|screen)[a-z]*\\b") | F.array_contains(listed, shape)).select("doc_id")


def nonface_reason(spark, sf):
    li = table(spark, sf, "lineitem")
    reason = F.when(F.col("l_discount") < 0.02, "detection").when(F.col("l_quantity") < 5, "size").when(F.col("l_tax") < 0.02, "quality")
    return li.withColumn("reason", reason).where("reason is not null and l_returnflag <> 'R'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def review_queue(spark, sf):
    e = table(spark, sf, "events").where("value < 50")
    w = windows.top_n(e, ["user_id", "event_type"], [F.coalesce("value", F.lit(0.0)).desc(), F.desc("ts"), F.asc("event_id")], 1)
    return w.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


def cooccurrence(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    a, b = e.select(*(F.col(c).alias(f"a_{c}") for c in e.columns), F.expr("us div 1000000").alias("sec")), e.select(*(F.col(c).alias(f"b_{c}") for c in e.columns), F.explode(F.expr("array(us div 1000000 - 1, us div 1000000, us div 1000000 + 1)")).alias("sec"))
    pairs = a.join(b, (a.sec == b.sec) & (F.col("a_event_type") == F.col("b_event_type")) & (F.col("a_user_id") < F.col("b_user_id")) & (F.abs(F.col("a_us") - F.col("b_us")) < 1_000_000))
    return pairs.select(F.col("a_user_id").alias("user_a"), F.col("b_user_id").alias("user_b"), F.col("a_event_id").alias("event_a"), F.col("b_event_id").alias("event_b"))


def temporal_link(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    span = 720_000_000
    a = e.withColumn("slot", F.expr(f"us div {span}")).alias("a")
    b = e.withColumn("slot", F.explode(F.expr(f"array(us div {span}, us div {span} - 1)"))).alias("b")
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.event_type") != F.col("b.event_type"))
    gap = F.col("b.us") - F.col("a.us")
    return a.join(b, on & (gap > 0) & (gap <= span)).select(F.col("a.event_id").alias("event_a"), F.col("b.event_id").alias("event_b"))


def latest_score(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_price"), F.max("o_orderdate").alias("last_date"))
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.round("last_price", 6).alias("last_price"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"))


def longest_prefix(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    roots = p.select(F.explode(F.array(F.regexp_extract("path", "^([^/]+)", 1), F.regexp_extract("path", "^([^/]+/[^/?#]+)", 1))).alias("root")).where("root <> ''").distinct()
    # candidates by equality on every prefix at a slash: no theta join
    cuts = p.withColumn("piece", F.split(F.regexp_replace("path", "[?#].*$", ""), "/"))
    cuts = cuts.select("page_id", F.posexplode("piece").alias("i", "x"), "piece").select("page_id", F.array_join(F.slice("piece", F.lit(1), F.col("i") + 1), "/").alias("root"))
    return cuts.join(roots, "root").groupBy("page_id").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("root"))


def timeline_days(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("view", "click")).alias("guessed"))


def timeline_totals(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), F.count_if(F.col("ts").isNull()).alias("undated"))


def person_stats(spark, sf):
    e = table(spark, sf, "events")
    day = F.to_date("ts")
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("faces"),
        F.count_distinct(F.when(F.col("event_type") == "view", day)).alias("photo_days"),
        F.count_distinct(F.when(F.col("event_type") != "view", day)).alias("video_days"),
        F.count_if(F.col("value") < 20).alias("unreviewed"),
    )


def library_totals(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("bytes"),
        F.round(F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("video_bytes"),
    )


def dashboard(spark, sf):
    parts = [
        table(spark, sf, "documents").agg(F.lit("documents").alias("what"), F.count(F.lit(1)).alias("n")),
        table(spark, sf, "labels").where("toxic = 1").agg(F.lit("toxic").alias("what"), F.count(F.lit(1)).alias("n")),
        table(spark, sf, "events").agg(F.lit("groups").alias("what"), F.count_distinct(F.struct("user_id", "event_type")).alias("n")),
        table(spark, sf, "orders").where("o_orderstatus = 'F'").agg(F.lit("failed").alias("what"), F.count(F.lit(1)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def home_cell(spark, sf):
    e = table(spark, sf, "events")
    cell = lambda c: (F.bround(c * 20) / 20).alias
    g = e.groupBy("user_id", cell(F.col("value") / 10)("lat"), cell(F.col("event_id") % 7 / 10)("lon")).agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count(F.lit(1)).alias("n"))
    return windows.best(g, ["user_id"], [F.col("days"), F.col("n"), -F.col("lat"), -F.col("lon")])


def latency_summary(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    v = F.array_sort(F.collect_list("value"))
    g = e.groupBy("event_type").agg(v.alias("v"), F.round(F.sum("value"), 4).alias("total"))
    n = F.size("v")
    return g.select("event_type", n.cast("long").alias("n"), F.get("v", F.floor(n / 2).cast("int")).alias("p50"), F.get("v", F.least(n - 1, F.floor(n * 0.95).cast("int"))).alias("p95"), F.get("v", n - 1).alias("top"), "total")


def nearest_rank(spark, sf):
    """The same percentiles by one global-free sort a group: rank windows bounded by count thresholds."""
    e = table(spark, sf, "events").where("value is not null")
    w = Window.partitionBy("event_type")
    r = e.select("event_type", "value", (F.row_number().over(w.orderBy("value", "event_id")) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where((F.col("r") == F.floor(F.col("n") / 2)) | (F.col("r") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)))).select("event_type", "r", "value")


def impostor_quantile(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.99), 6).alias("q99"), F.count("value").alias("n"))


def confusion(spark, sf):
    d, la = table(spark, sf, "documents"), table(spark, sf, "labels")
    said = (F.col("n_chars") >= 800).cast("int")
    r = d.join(la, "doc_id").select(said.alias("p"), F.col("quality").alias("y"))
    r = r.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("tp", "p = 1 and y = 1"), ("fp", "p = 1 and y = 0"), ("fn", "p = 0 and y = 1"))))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return r.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(1.25 * precision * recall / (0.25 * precision + recall), 6).alias("f_half"))


def coverage(spark, sf):
    d, la = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has"))
    return d.join(la, "doc_id", "left").groupBy("lang").agg(F.count("has").alias("filled"), F.count(F.lit(1)).alias("total"), F.round(F.count("has") / F.count(F.lit(1)), 6).alias("coverage"))


def signature_all(spark, sf):
    """The watermark is the greatest id of the table."""
    d = table(spark, sf, "documents")
    return d.agg(F.concat_ws(":", F.count("doc_id").cast("string"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n_chars"))).cast("string")).alias("signature"))


def top_kinds(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_n(g, ["user_id"], [F.desc("n"), F.asc("event_type")], 3, "rank").select("user_id", "event_type", "n", F.col("rank").cast("long").alias("rank"))


def scan_stats(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("n_chars") > 2000).alias("changed"), F.round(F.sum("n_chars") / 1e6, 6).alias("mb"))


def two_level_sample(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    s = windows.two_level_sample(e, "user_id", ["day"], [F.desc("value"), F.asc("event_id")], 5)
    return s.select("user_id", "event_id", F.col("sample_rank").cast("long").alias("sample_rank"))


def representative(spark, sf):
    li = table(spark, sf, "lineitem")
    b = windows.best(li, ["l_partkey"], [F.col("l_quantity"), F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber")])
    return b.select("l_partkey", "l_orderkey", "l_linenumber")


def event_cover(spark, sf):
    o = table(spark, sf, "orders")
    return windows.top_n(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1).select("o_custkey", "o_orderkey")


def per_group_cap(spark, sf):
    li = table(spark, sf, "lineitem")
    capped = windows.top_n(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)
    return capped.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(40).select("l_suppkey", "l_orderkey", "l_linenumber")


def pseudo_random(spark, sf):
    return windows.pseudo_random(table(spark, sf, "documents"), "doc_id", 60).select("doc_id")


def running_offset(spark, sf):
    days = timeline_days(spark, sf)
    w = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    return days.select("day", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))


def scrub_marks(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"))
    return o.agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


def set_ops(spark, sf):
    e = table(spark, sf, "events")
    kinds = e.where("value > 80").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("high"))
    low = e.where("value < 20").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("low"))
    j = kinds.join(low, "user_id", "full").select("user_id", F.coalesce("high", F.array().cast("array<string>")).alias("high"), F.coalesce("low", F.array().cast("array<string>")).alias("low"))
    both, every = F.size(F.array_intersect("high", "low")), F.size(F.array_union("high", "low"))
    return j.select("user_id", both.cast("long").alias("both"), F.round(both / every, 6).alias("jaccard"), F.array_join(F.array_except("high", "low"), ",").alias("only_high"))


def protected_union(spark, sf):
    a = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    return a.union(b).distinct()


def resolve_keep(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_orderkey").exceptAll(li.where("l_returnflag = 'A'").select("l_orderkey")).distinct().join(li.where("l_returnflag = 'A'"), "l_orderkey", "left_anti")


def reconcile_keys(spark, sf):
    e, la = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key")), table(spark, sf, "labels").select(F.col("doc_id").alias("key"))
    return e.join(la, "key", "left_anti").select("key", F.lit("extra").alias("state")).union(la.join(e, "key", "left_anti").select("key", F.lit("missing").alias("state")))


def ignored_groups(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("fingerprint"))
    ignored = g.where("l_orderkey % 3 = 0").select("fingerprint")
    return g.join(ignored, "fingerprint", "left_anti").select("l_orderkey", "fingerprint")


QUERIES = {
    "q_facet_filter_page": (facet_filter_page, r"""SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 200 AND 20000 AND (text ILIKE '%TH\_e%' ESCAPE '\' OR text ILIKE '%the %') ORDER BY n_chars DESC, doc_id DESC LIMIT 50 OFFSET 50"""),
    "q_date_range": (date_facet, "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' AND event_type IS NOT NULL"),
    "q_people_any": (people_any, f"SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey IN {PARTS})"),
    "q_people_all": (people_all, "SELECT user_id FROM events WHERE value > 60 AND event_type IN ('click', 'view', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 3"),
    "q_exclude_people": (exclude_people, "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey <= 100)"),
    "q_no_faces": (no_faces, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "q_min_quality": (min_quality, "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)"),
    "q_bbox_antimeridian": (bbox_antimeridian, "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 180 - 90 BETWEEN -40 AND 60 AND (c_acctbal % 180 >= 150 OR c_acctbal % 180 <= -20)"),
    "q_orphans": (orphans, "SELECT doc_id, 'unlabelled' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    "q_screenshots": (screenshots, r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)^(the|screen)[a-z]*\b') OR (doc_id % 4, n_chars % 3) IN ((1, 2), (2, 1), (3, 0))"),
    "q_nonface_reason": (nonface_reason, "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_discount < 0.02 THEN 'detection' WHEN l_quantity < 5 THEN 'size' WHEN l_tax < 0.02 THEN 'quality' END AS reason FROM lineitem WHERE l_returnflag <> 'R') WHERE reason IS NOT NULL GROUP BY reason"),
    "q_review_dedupe": (review_queue, "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(value, 0) DESC, ts DESC, event_id) AS r FROM events WHERE value < 50) WHERE r = 1"),
    "q_cooccurrence": (cooccurrence, "SELECT a.user_id AS user_a, b.user_id AS user_b, a.event_id AS event_a, b.event_id AS event_b FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id < b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 1000000"),
    "q_temporal_link": (temporal_link, "SELECT a.event_id AS event_a, b.event_id AS event_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND epoch_us(b.ts) - epoch_us(a.ts) > 0 AND epoch_us(b.ts) - epoch_us(a.ts) <= 720000000"),
    "q_latest_score": (latest_score, "SELECT c_custkey, round(o_totalprice, 6) AS last_price, strftime(o_orderdate, '%Y-%m-%d') AS last_date FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1"),
    "q_longest_prefix": (longest_prefix, r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), roots AS (SELECT DISTINCT unnest([regexp_extract(path, '^([^/]+)', 1), regexp_extract(path, '^([^/]+/[^/?#]+)', 1)]) AS root FROM p) SELECT page_id, root FROM (SELECT page_id, root, row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC, root DESC) AS r FROM (SELECT page_id, regexp_replace(path, '[?#].*$', '') AS path FROM p) JOIN roots ON root <> '' AND (path = root OR starts_with(path, root || '/'))) WHERE r = 1"""),
    "q_timeline_days": (timeline_days, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click')) AS guessed FROM events GROUP BY 1"),
    "q_timeline_totals": (timeline_totals, "SELECT count(*) AS n, count(DISTINCT ts::DATE) AS days, count(*) FILTER (ts IS NULL) AS undated FROM events"),
    "q_person_stats": (person_stats, "SELECT user_id, count(*) AS faces, count(DISTINCT CASE WHEN event_type = 'view' THEN ts::DATE END) AS photo_days, count(DISTINCT CASE WHEN event_type <> 'view' THEN ts::DATE END) AS video_days, count(*) FILTER (value < 20) AS unreviewed FROM events GROUP BY user_id"),
    "q_library_totals": (library_totals, "SELECT l_returnflag, count(*) AS items, round(coalesce(sum(l_extendedprice), 0), 2) AS bytes, round(coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 0), 2) AS video_bytes FROM lineitem GROUP BY 1"),
    "q_dashboard": (dashboard, "SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'toxic', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'groups', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) UNION ALL SELECT 'failed', count(*) FROM orders WHERE o_orderstatus = 'F'"),
    "q_home_cell": (home_cell, "SELECT user_id, lat, lon, days, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, n DESC, lat, lon) AS r FROM (SELECT user_id, round_even(value / 10 * 20, 0) / 20 AS lat, round_even((event_id % 7) / 10 * 20, 0) / 20 AS lon, count(DISTINCT ts::DATE) AS days, count(*) AS n FROM events GROUP BY 1, 2, 3)) WHERE r = 1"),
    "q_latency_summary": (latency_summary, "SELECT event_type, len(v) AS n, v[len(v) // 2 + 1] AS p50, v[least(len(v) - 1, floor(len(v) * 0.95)::BIGINT) + 1] AS p95, v[len(v)] AS top, total FROM (SELECT event_type, list_sort(list(value)) AS v, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY 1)"),
    "q_nearest_rank": (nearest_rank, "SELECT event_type, r, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = n // 2 OR r = least(n - 1, floor(n * 0.95))"),
    "q_impostor_quantile": (impostor_quantile, "SELECT event_type, round(quantile_cont(value, 0.99), 6) AS q99, count(value) AS n FROM events GROUP BY 1"),
    "q_confusion": (confusion, "WITH c AS (SELECT count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn FROM (SELECT (n_chars >= 800)::INT AS p, quality AS y FROM documents JOIN labels USING (doc_id))), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS a, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS b FROM c) SELECT tp, fp, fn, round(a, 6) AS precision, round(b, 6) AS recall, round(1.25 * a * b / (0.25 * a + b), 6) AS f_half FROM r"),
    "q_coverage": (coverage, "SELECT lang, count(l.doc_id) AS filled, count(*) AS total, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang"),
    "q_signature_all": (signature_all, "SELECT count(*) || ':' || sum(n_chars)::BIGINT AS signature FROM documents WHERE doc_id <= (SELECT max(doc_id) FROM documents)"),
    "q_top_kinds": (top_kinds, "SELECT user_id, event_type, n, rank FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 3"),
    "q_scan_stats": (scan_stats, "SELECT source, count(*) AS files, count(*) FILTER (n_chars > 2000) AS changed, round(sum(n_chars) / 1e6, 6) AS mb FROM documents GROUP BY 1"),
    "q_two_level_sample": (two_level_sample, "SELECT user_id, event_id, sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1) WHERE sample_rank <= 5"),
    "q_representative": (representative, "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1"),
    "q_event_cover": (event_cover, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "q_per_group_cap": (per_group_cap, "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40"),
    "q_pseudo_random": (pseudo_random, "SELECT doc_id FROM documents ORDER BY (doc_id * 7919) % 1009, doc_id LIMIT 60"),
    "q_running_offset": (running_offset, "SELECT day, n, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)"),
    "q_scrub_marks": (scrub_marks, "SELECT year, month, o_orderkey AS first_order FROM (SELECT *, year(o_orderdate) AS year, month(o_orderdate) AS month, row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "q_set_ops": (set_ops, "WITH h AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS high FROM events WHERE value > 80 GROUP BY 1), l AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS low FROM events WHERE value < 20 GROUP BY 1), j AS (SELECT coalesce(h.user_id, l.user_id) AS user_id, coalesce(high, []) AS high, coalesce(low, []) AS low FROM h FULL JOIN l ON h.user_id = l.user_id) SELECT user_id, len(list_intersect(high, low)) AS both, round(len(list_intersect(high, low)) / len(list_distinct(list_concat(high, low))), 6) AS jaccard, array_to_string(list_filter(high, lambda x: NOT list_contains(low, x)), ',') AS only_high FROM j"),
    "q_protected_union": (protected_union, "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000"),
    "q_resolve_keep": (resolve_keep, "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'"),
    "q_reconcile_keys": (reconcile_keys, "SELECT vec_id AS key, 'extra' AS state FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "q_ignored_groups": (ignored_groups, "WITH g AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS fingerprint FROM lineitem GROUP BY 1) SELECT l_orderkey, fingerprint FROM g WHERE fingerprint NOT IN (SELECT fingerprint FROM g WHERE l_orderkey % 3 = 0)"),
}
