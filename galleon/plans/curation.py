"""Facets, reviews, people, albums, events, counts and vector upkeep as registered queries with SQL twins.

Orders stand for media items, line items for faces, customers for people and edits.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import facets, identity, library, vectors, windows
from ..session import table

MEDIA = """media AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'Screenshot_' WHEN 1 THEN 'Capture 7' ELSE 'IMG_' END || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '.PNG' ELSE '.jpg' END AS name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'video' ELSE 'photo' END AS kind, floor(o_totalprice)::BIGINT AS size, CASE WHEN o_orderstatus = 'P' THEN '2024-01-01' END AS deleted_at, (o_orderkey % 11 = 0)::INT AS missing,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS captured_at, o_orderdate + INTERVAL 1 DAY AS indexed_at, CASE o_orderkey % 17 WHEN 0 THEN 'failed' WHEN 1 THEN 'stale' ELSE 'indexed' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 1080 WHEN 1 THEN 1920 ELSE 800 END AS width, CASE o_custkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1080 ELSE 600 END AS height, CASE WHEN o_orderkey % 6 = 0 THEN 'X' END AS camera_make,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Y' END AS camera_model, CASE WHEN o_orderkey % 7 <> 0 THEN 'h' || o_custkey END AS content_hash, o_custkey % 4 AS duplicate_count, CASE WHEN o_orderkey % 10 = 0 THEN 'mtime' END AS date_source FROM orders)"""
FACES = """faces AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS media_id, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey END AS person_id, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 3 END AS track_id,
  CASE WHEN l_quantity <> 7 THEN l_quantity / 50 END AS quality, 0.4 + l_discount * 6 AS detection, CASE WHEN l_tax <> 0 THEN 0.3 + l_tax * 5 END AS similarity,
  CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'rejected' ELSE 'unreviewed' END AS review_state, (l_linenumber = 5)::INT AS manual, CASE WHEN l_linenumber = 7 THEN 'x' END AS deleted_at,
  l_quantity AS w, l_quantity + 3 AS h FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1)"""
EDITS = "edits AS (SELECT c_custkey AS media_id, c_custkey % 6 AS rating, CASE c_custkey % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'GREEN' END AS label, CASE c_custkey % 4 WHEN 0 THEN 'pick' WHEN 1 THEN 'reject' END AS flag FROM customer)"
PEOPLE = "people AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN ' ' END AS name FROM supplier)"
MEMBERS = "members AS (SELECT o_orderkey AS media_id, o_custkey AS event_id, (o_orderkey % 3 = 0)::INT AS locked FROM orders)"
LIVE = "(SELECT f.* FROM faces f JOIN media m ON m.id = f.media_id WHERE f.deleted_at IS NULL AND m.deleted_at IS NULL AND m.missing = 0)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _pick(key, cases: dict, other=None):
    out = F.lit(other)
    for k, v in cases.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def media(spark, sf, n: int | None = None):
    """Orders as media; dealt by id into ``n`` parts where that is given."""
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    if n:
        o = o.repartition(n, k)
    name = F.concat(_pick(k % 9, {0: "Screenshot_", 1: "Capture 7"}, "IMG_"), k.cast("string"), F.when(k % 4 == 0, ".PNG").otherwise(".jpg"))
    return o.select(
        k.alias("id"), name.alias("name"), F.when(k % 5 == 0, "video").otherwise("photo").alias("kind"), F.floor("o_totalprice").alias("size"),
        F.when(F.col("o_orderstatus") == "P", "2024-01-01").alias("deleted_at"), (k % 11 == 0).cast("int").alias("missing"), F.when(k % 13 != 0, F.col("o_orderdate")).alias("captured_at"),
        (F.col("o_orderdate") + F.expr("interval 1 day")).alias("indexed_at"), _pick(k % 17, {0: "failed", 1: "stale"}, "indexed").alias("status"), _pick(k % 3, {0: 1080, 1: 1920}, 800).alias("width"),
        _pick(c % 3, {0: 1920, 1: 1080}, 600).alias("height"), F.when(k % 6 == 0, "X").alias("camera_make"), F.when(k % 6 == 0, "Y").alias("camera_model"),
        F.when(k % 7 != 0, F.concat(F.lit("h"), c.cast("string"))).alias("content_hash"), (c % 4).alias("duplicate_count"), F.when(k % 10 == 0, "mtime").alias("date_source"),
    )


def faces(spark, sf, parts: int | None = None, by: str = "id"):
    """Line items as faces; dealt by ``id`` or ``media_id`` into ``parts`` where that is given."""
    li = table(spark, sf, "lineitem")
    if parts:
        li = li.repartition(parts, *(["l_orderkey", "l_linenumber"] if by == "id" else ["l_orderkey"]))
    li, n = windows.top_n(li, ["l_orderkey", "l_linenumber"], [F.asc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey")]), F.col("l_linenumber")
    q = F.col("l_quantity")
    found = _faces(li, n, q)
    return found.repartition(parts, "id") if parts and by == "id" else found


def _faces(li, n, q):
    return li.select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("media_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("person_id"), F.when(n % 2 == 0, F.col("l_partkey") % 3).alias("track_id"),
        F.when(q != 7, q / 50).alias("quality"), (0.4 + F.col("l_discount") * 6).alias("detection"), F.when(F.col("l_tax") != 0, 0.3 + F.col("l_tax") * 5).alias("similarity"),
        _pick(F.col("l_returnflag"), {"A": "confirmed", "R": "rejected"}, "unreviewed").alias("review_state"), (n == 5).cast("int").alias("manual"), F.when(n == 7, "x").alias("deleted_at"),
        F.array(F.lit(0.0), F.lit(0.0), q, q + 3).alias("bbox"), F.lit(None).cast("array<array<double>>").alias("landmarks"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"),
    )


def edits(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("media_id"), (k % 6).alias("rating"), _pick(k % 3, {0: "Red", 1: "GREEN"}).alias("label"), _pick(k % 4, {0: "pick", 1: "reject"}).alias("flag"))


def people(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, " ").alias("name"))


def members(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("media_id"), F.col("o_custkey").alias("event_id"), (k % 3 == 0).cast("int").alias("locked"))


def _ids(df, condition):
    return df.where(condition).select("id")


def q_reviewed(spark, sf):
    return facets.with_reviewed(media(spark, sf), faces(spark, sf), "confirmed").select("id", "name")


def q_confident(spark, sf):
    return facets.with_confidence(media(spark, sf), faces(spark, sf), 0.6).select("id", "kind")


def q_event_members(spark, sf):
    return facets.members(media(spark, sf), members(spark, sf), "event_id", 7).select("id", "name")


def q_favorites(spark, sf):
    return facets.members(media(spark, sf), edits(spark, sf)).select("id", "size")


def q_rated(spark, sf):
    return facets.rated(media(spark, sf), edits(spark, sf), 4).select("id")


def q_color_label(spark, sf):
    return facets.labelled(media(spark, sf), edits(spark, sf), "green").select("id")


def _flag(flag):
    return lambda spark, sf: facets.flagged(media(spark, sf), edits(spark, sf), flag).select("id")


def q_named_or_numbered(spark, sf):
    return facets.named_or_numbered(people(spark, sf), "7")


def q_screenshot_photos(spark, sf):
    return facets.screenshots(media(spark, sf)).select("id", "name")


def q_nonfaces(spark, sf):
    found = facets.nonfaces(faces(spark, sf).drop("width", "height"), media(spark, sf), people(spark, sf), 0.5, 6, 0.3)
    return found.select("id", "person_id", "reason")


def q_usable_crops(spark, sf):
    return facets.usable(faces(spark, sf)).select("id")


def _done(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("media_id"), (k % 3).alias("version"), F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00")).alias("computed_at"), F.when(k % 4 != 0, "m").alias("model_key"))


DONE = "done AS (SELECT c_custkey AS media_id, c_custkey % 3 AS version, TIMESTAMP '1995-06-01' AS computed_at, CASE WHEN c_custkey % 4 <> 0 THEN 'm' END AS model_key FROM customer)"


def q_pending_quality(spark, sf):
    return facets.pending(media(spark, sf), _done(spark, sf), 2).select("id")


def q_pending_video(spark, sf):
    return facets.pending(media(spark, sf), _done(spark, sf), 2, kind="video", model="m").select("id")


def q_sort_name(spark, sf):
    rows, total = facets.page_and_total(media(spark, sf).where("deleted_at is null"), facets.order("name"), 2, 40)
    return rows.select("id", "name", F.lit(total).cast("long").alias("total"))


def q_collapse_backlog(spark, sf):
    return library.collapse_backlog(faces(spark, sf)).select("id", "review_state")


def q_auto_confirm(spark, sf):
    return library.auto_confirm(faces(spark, sf), 0.55, 0.5).select("id", "review_state")


def _feedback(f):
    return f.where("id % 4 = 0 and person_id is not null").select(F.col("id").alias("face_id"), F.when(F.col("id") % 8 == 0, F.col("person_id")).otherwise(F.lit(1)).alias("person_id"), F.lit(0.5).alias("similarity"), F.lit(1).alias("correct"))


FEEDBACK = "feedback AS (SELECT id AS face_id, CASE WHEN id % 8 = 0 THEN person_id ELSE 1 END AS person_id, 0.5 AS similarity, 1 AS correct FROM faces WHERE id % 4 = 0 AND person_id IS NOT NULL)"


def _review(decision):
    def run(spark, sf):
        f = faces(spark, sf, windows.parts(table(spark, sf, "lineitem")))
        none = f.where("id % 5 = 1 and person_id is not null").select(F.col("id").alias("face_id"), "person_id")
        return library.review(f, _ids(f, "id % 3 = 0"), decision, _feedback(f), none, none.withColumn("similarity", F.lit(0.1)))

    return run


def q_review_no(spark, sf):
    r = _review("no")(spark, sf)
    state = r["faces"].select("id", F.concat_ws(":", "review_state", F.col("manual").cast("string")).alias("value"), F.lit("face").alias("what"))
    rejected = r["rejections"].groupBy().agg(F.count(F.lit(1)).alias("id"), F.sum("person_id").cast("string").alias("value")).withColumn("what", F.lit("rejections"))
    learnt = r["feedback"].select(F.col("face_id").alias("id"), F.concat_ws(":", F.col("person_id").cast("string"), F.col("correct").cast("string")).alias("value"), F.lit("feedback").alias("what"))
    return state.unionByName(rejected).unionByName(learnt)


def q_review_reset(spark, sf):
    r = _review("reset")(spark, sf)
    state = r["faces"].select("id", F.concat_ws(":", "review_state", F.col("manual").cast("string")).alias("value"), F.lit("face").alias("what"))
    return state.unionByName(r["rejections"].select(F.col("face_id").alias("id"), F.col("person_id").cast("string").alias("value"), F.lit("rejection").alias("what"))).unionByName(
        r["feedback"].select(F.col("face_id").alias("id"), F.col("correct").cast("string").alias("value"), F.lit("feedback").alias("what"))
    )


def q_representatives(spark, sf):
    return library.representatives(faces(spark, sf))


def q_merge_people(spark, sf):
    f = faces(spark, sf)
    pairs = f.where("person_id is not null").select("person_id", "media_id").distinct()
    r = library.merge_people(f, people(spark, sf), pairs, pairs.limit(0), 3, 4)
    ex = r["exclusions"].groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("exclusions").alias("what"), F.col("person_id").alias("id"), F.col("n").cast("string").alias("value"))
    fc = r["faces"].where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("faces").alias("what"), F.col("person_id").alias("id"), F.col("n").cast("string").alias("value"))
    return ex.unionByName(fc).unionByName(r["people"].select(F.lit("name").alias("what"), "id", F.col("name").alias("value")))


def q_move_faces(spark, sf):
    f = faces(spark, sf, windows.parts(table(spark, sf, "lineitem")))
    return library.move_faces(f, _ids(f, "id % 7 = 0"), 2)[0].select("id", "person_id", "manual", "review_state", F.round("similarity", 6).alias("similarity"))


def q_undo_move(spark, sf):
    f = faces(spark, sf, windows.parts(table(spark, sf, "lineitem")))
    moved, undo = library.move_faces(f, _ids(f, "id % 7 = 0"), 2)
    return library.put_back(moved, undo).select("id", "person_id", "manual", "review_state", F.round("similarity", 6).alias("similarity"))


def q_set_favorite(spark, sf):
    m = media(spark, sf)
    fav = m.where("id % 6 = 0").select(F.col("id").alias("media_id"))
    on, undo = library.set_favorite(fav, m, _ids(m, "id % 4 = 0"), True)
    off, _ = library.set_favorite(on, m, _ids(m, "id % 10 = 0"), False)
    return off.select("media_id", F.lit("favorite").alias("what")).unionByName(undo.select("media_id", F.lit("undo").alias("what")))


def q_soft_delete(spark, sf):
    m = media(spark, sf, windows.parts(table(spark, sf, "orders")))
    gone, undo = library.soft_delete(m, _ids(m, "id % 3 = 0"), True, "2025-05-05")
    back, _ = library.soft_delete(gone, _ids(m, "id % 5 = 0"), False)
    return back.select("id", "deleted_at").join(undo.select("id", F.lit(1).alias("in_undo")), "id", "left")


def _album(spark, sf):
    c = table(spark, sf, "orders")
    return c.select((F.col("o_custkey") % 50).alias("album_id"), F.col("o_orderkey").alias("media_id"), F.row_number().over(Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey")).cast("long").alias("position"))


ALBUM = "album AS (SELECT o_custkey % 50 AS album_id, o_orderkey AS media_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS position FROM orders)"


def q_album_remove(spark, sf):
    return library.remove_from_album(_album(spark, sf), 7, _ids(media(spark, sf), "id % 2 = 0"))[0]


def q_album_covers(spark, sf):
    a = _album(spark, sf)
    albums = a.groupBy("album_id").agg(F.min("media_id").alias("m")).select("album_id", F.when(F.col("album_id") % 3 == 0, F.col("m") + 1).when(F.col("album_id") % 3 == 1, F.col("m")).alias("cover_media_id"))
    return library.album_covers(albums, a)


def q_event_merge(spark, sf):
    return library.merge_events(members(spark, sf), [4, 7, 8])[0]


def q_event_split(spark, sf):
    m = members(spark, sf)
    at = m.where("event_id = 7").groupBy().agg(F.max("media_id")).first()[0]
    return library.split_event(m, media(spark, sf), 7, at or 0, 1_000_000)[0]


def q_event_move(spark, sf):
    return library.move_to_event(members(spark, sf), _ids(media(spark, sf), "id % 50 = 0"), 7)[0]


def _auto_events(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("start_at"), F.max("o_orderdate").alias("end_at")).withColumn("user_edited", (F.col("id") % 2).cast("int"))


def q_detection_window(spark, sf):
    m = media(spark, sf)
    top = m.agg(F.max("id")).first()[0]
    w = library.detection_window(m, _auto_events(spark, sf), top - 3)
    return w.select(F.date_format("lo", "yyyy-MM-dd HH:mm:ss").alias("lo"), F.date_format("hi", "yyyy-MM-dd HH:mm:ss").alias("hi"))


def q_stable_ids(spark, sf):
    o = table(spark, sf, "orders")
    found = o.select(F.col("o_custkey").alias("scope"), F.year("o_orderdate").cast("long").alias("group"), F.col("o_orderkey").alias("media_id"))
    current = o.select(F.col("o_orderkey").alias("media_id"), (F.col("o_custkey") * 10 + F.month("o_orderdate") % 3).alias("event_id"), (F.col("o_orderkey") % 9 == 0).cast("int").alias("locked"))
    ev = current.select(F.col("event_id").alias("id")).distinct().withColumn("user_edited", (F.col("id") % 7 == 0).cast("int"))
    return library.stable_ids(found, current, ev).select("scope", "group", "event_id", "changed")


def q_undoable(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.when(F.col("event_id") % 4 == 3, F.col("event_id") - 2).alias("undoes"))
    return library.undoable(log)


def q_relink_report(spark, sf):
    m = media(spark, sf).select("id", F.concat(F.lit("/old/"), "name").alias("path"), "size", F.lit(0).cast("long").alias("mtime_ns"), "deleted_at", "missing", "status")
    files = m.where("id % 3 <> 0").select(F.concat(F.lit("/new/"), F.substring("path", 6, 99)).alias("path"), "size", F.when(F.col("id") % 5 == 0, 3_000_000_000).otherwise(5).alias("mtime_ns"))
    return library.relink_report(m, files, "/old/", "/new")


def q_package_identity(spark, sf):
    m = media(spark, sf)
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("rec"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h"), F.col("c_custkey").cast("string"))).alias("content_hash"))
    shape = m.select(F.col("id").alias("rec"), "name", "size", "kind")
    return library.package_identity(records.join(shape, "rec"), m)


def q_sidecar_owner(spark, sf):
    m = media(spark, sf).select("id", F.concat(F.lit("/a/"), "name").alias("path"))
    k = F.col("id")
    s = m.where("id % 5 < 3").select(F.when(k % 3 == 0, F.concat("path", F.lit(".xmp"))).otherwise(F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit(".xmp"))).alias("sidecar"))
    return library.sidecar_owner(s, m)


def q_review_breakdown(spark, sf):
    return library.review_breakdown(faces(spark, sf), media(spark, sf))


def q_cleanup_counts(spark, sf):
    return library.cleanup_counts(faces(spark, sf), media(spark, sf), 0.5)


def q_library_counts(spark, sf):
    return library.library_counts(media(spark, sf), faces(spark, sf), people(spark, sf))


def q_clutter(spark, sf):
    m = media(spark, sf)
    return library.clutter({"old": m.where("id % 3 = 0"), "shots": facets.screenshots(m), "dark": m.where("id % 4 = 0")})


def q_hit_rate(spark, sf):
    return library.hit_rate(table(spark, sf, "events").select(F.col("event_type").alias("name"), (F.col("value") > 40).alias("hit")))


def q_slowest_folders(spark, sf):
    e = table(spark, sf, "events")
    return library.slowest_folders(e.groupBy(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("value").alias("seconds")))


def q_memories_today(spark, sf):
    return library.on_this_day(media(spark, sf), "1997-06-15")


def _jobs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("user_id") % 7).alias("priority"), _pick(F.col("event_id") % 3, {0: "queued", 1: "running"}, "done").alias("status"))


JOBS = "jobs AS (SELECT event_id AS id, event_type AS kind, user_id % 7 AS priority, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS status FROM events)"


def q_next_job(spark, sf):
    return library.next_job(_jobs(spark, sf), ["view", "click"])


def q_job_list(spark, sf):
    return _jobs(spark, sf).orderBy(*library.job_order()).limit(50).select("id", "status")


def q_feedback_samples(spark, sf):
    f = faces(spark, sf)
    fb = f.where("person_id is not null").select(F.col("id").alias("face_id"), "person_id", F.lit(0.7).alias("similarity"), (F.col("review_state") == "confirmed").cast("int").alias("correct"), F.lit("2025").alias("reviewed_at"))
    rows = library.feedback_samples(fb, f, media(spark, sf), 4000)
    return rows.select("face_id", "person_id", "media_id", "correct", F.round("quality", 6).alias("quality"))


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    key = F.when(F.col("vec_id") % 10 == 9, F.col("vec_id") - 1).otherwise(F.col("vec_id"))
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 5)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    return e.select(key.alias("key"), v.alias("embedding"))


def q_refused_vectors(spark, sf):
    good, refused = library.valid_vectors(_vectors(spark, sf), 64)
    return refused.unionByName(good.select("key", F.lit("ok").alias("reason")))


def q_sync_index(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label")
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 400).alias("key"), (F.col("value") < 30).alias("deleted"))
    old = e.where("key % 3 <> 0").withColumn("label", F.lit(-1))
    return library.sync_index(old, e, log, 100, 700)


def q_index_gaps(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"))
    return library.index_gaps(e.where("key % 5 <> 0"), e.where("key % 7 <> 0"))


def q_backfill(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"))
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("media_id"), (F.col("c_custkey") % 5).alias("attempts"), (F.col("c_custkey") % 3).alias("priority"))
    return library.backfill(media(spark, sf), v, q, 200)


def q_merge_preview(spark, sf):
    e = table(spark, sf, "embeddings")
    f = e.select(F.col("vec_id").alias("id"), F.col("label").alias("person_id"), F.lit(None).cast("string").alias("deleted_at"), F.lit("x").alias("review_state"), (F.col("vec_id") % 10 / 10.0).alias("quality"), vectors.unit(F.col("embedding")).alias("embedding"))
    return library.merge_preview(f, 1, 2)


def q_adjusted_similarity(spark, sf):
    f = faces(spark, sf)
    return f.select("id", F.round(X.adjusted_similarity(F.col("similarity"), F.coalesce("quality", F.lit(0.5)), 0.5), 6).alias("s"))


def q_probability(spark, sf):
    f = faces(spark, sf)
    return f.select("id", F.round(X.probability([4.0, 1.0, 0.5], -3.0, F.col("similarity"), F.col("quality"), F.least(F.col("detection"), F.lit(1.0))), 6).alias("p"))


def q_day_span(spark, sf):
    o = table(spark, sf, "orders")
    end = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40).cast("int"))
    return o.select("o_orderkey", X.day_span(F.col("o_orderdate"), end).alias("days"))


def q_output_size(spark, sf):
    m = media(spark, sf)
    crop = F.when(F.col("id") % 3 != 0, X.normal_crop(F.lit(-0.1), F.col("id") % 7 / 10.0, F.lit(0.9), F.lit(0.5)))
    size = X.output_size(F.col("width"), F.col("height"), F.col("id") % 4 * 90, crop)
    return m.select("id", size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height"))


def _versions(spark, sf):
    k = F.col("c_custkey")
    mine = table(spark, sf, "customer").where(k % 2 == 0).select(k.alias("media_id"), (k % 5 + 1).alias("version"), (k % 4 * 90).alias("rotation"), (k % 6).alias("rating"), _pick(k % 3, {0: "Red"}).alias("label"), F.lit(None).cast("string").alias("flag"))
    new = table(spark, sf, "customer").where(k % 3 == 0).select(k.alias("media_id"), (k % 4 * 90).alias("rotation"), (k % 5).alias("rating"), F.lit("Red").alias("label"), F.lit(None).cast("string").alias("flag"))
    return mine, new


def q_store_edits(spark, sf):
    edits, history = library.store_edits(*_versions(spark, sf))
    done = history.select("media_id", F.col("before.rating").alias("rating_before"), F.lit(1).alias("in_history"))
    return edits.join(done, "media_id", "left").select("media_id", "version", "rating", "label", "rating_before", "in_history")


def q_revert_edits(spark, sf):
    edits, history = library.store_edits(*_versions(spark, sf))
    return library.revert_edits(edits, history.where("media_id % 9 = 0")).select("media_id", "version", "rating", "label")


def q_cluster_samples(spark, sf):
    return library.cluster_samples(faces(spark, sf), 5)


def q_tracker_splits(spark, sf):
    li = table(spark, sf, "lineitem")
    at = (F.col("l_linenumber") * 5 + F.col("l_partkey") % 3).cast("double")
    seen = li.select(F.col("l_suppkey").alias("person_id"), (F.col("l_orderkey") % 500).alias("media_id"), at.alias("timestamp"), (F.col("l_suppkey") % 50 * 1.0).alias("cx"), (F.col("l_partkey") % 50 * 1.0).alias("cy"), (F.col("l_quantity") / 5).alias("size"))
    return identity.tracker_splits(seen)


VERSIONS = "e AS (SELECT c_custkey AS id, c_custkey % 5 + 1 AS v, c_custkey % 6 AS r, CASE WHEN c_custkey % 3 = 0 THEN 'Red' END AS l FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS id, c_custkey % 5 AS r FROM customer WHERE c_custkey % 3 = 0), j AS (SELECT coalesce(e.id, n.id) AS id, e.v, e.r, e.l, n.r AS nr, n.id IS NOT NULL AND (e.id IS NULL OR e.r <> n.r) AS hit FROM e FULL JOIN n ON e.id = n.id)"
TWICE = "(SELECT key FROM v GROUP BY key HAVING count(*) > 1)"
STATE = "CASE WHEN deleted_at IS NULL AND id % 3 = 0 AND (review_state <> '{0}' OR manual <> {1} OR {2}) THEN '{0}:{1}' ELSE review_state || ':' || manual END"
REVIEW = _with(FACES, FEEDBACK, "chosen AS (SELECT * FROM faces WHERE id % 3 = 0 AND deleted_at IS NULL)", "none AS (SELECT id AS face_id, person_id FROM faces WHERE id % 5 = 1 AND person_id IS NOT NULL)")

QUERIES = {
    "q_reviewed": (q_reviewed, _with(MEDIA, FACES) + "SELECT id, name FROM media WHERE id IN (SELECT media_id FROM faces WHERE deleted_at IS NULL AND review_state = 'confirmed')"),
    "q_confident": (q_confident, _with(MEDIA, FACES) + "SELECT id, kind FROM media WHERE id IN (SELECT media_id FROM faces WHERE deleted_at IS NULL AND similarity >= 0.6)"),
    "q_event_members": (q_event_members, _with(MEDIA, MEMBERS) + "SELECT id, name FROM media WHERE EXISTS (SELECT 1 FROM members WHERE media_id = id AND event_id = 7)"),
    "q_favorites": (q_favorites, _with(MEDIA, EDITS) + "SELECT id, size FROM media WHERE id IN (SELECT media_id FROM edits)"),
    "q_rated": (q_rated, _with(MEDIA, EDITS) + "SELECT id FROM media WHERE id IN (SELECT media_id FROM edits WHERE rating >= 4)"),
    "q_color_label": (q_color_label, _with(MEDIA, EDITS) + "SELECT id FROM media WHERE id IN (SELECT media_id FROM edits WHERE lower(label) = 'green')"),
    "q_flag_pick": (_flag("pick"), _with(MEDIA, EDITS) + "SELECT id FROM media WHERE id IN (SELECT media_id FROM edits WHERE flag = 'pick')"),
    "q_unflagged": (_flag("unflagged"), _with(MEDIA, EDITS) + "SELECT id FROM media WHERE NOT EXISTS (SELECT 1 FROM edits WHERE media_id = id AND flag IS NOT NULL)"),
    "q_named_or_numbered": (q_named_or_numbered, _with(PEOPLE) + "SELECT * FROM people WHERE name ILIKE '%7%' OR id::VARCHAR LIKE '%7%'"),
    "q_screenshot_photos": (q_screenshot_photos, _with(MEDIA) + "SELECT id, name FROM media WHERE deleted_at IS NULL AND missing = 0 AND kind = 'photo' AND camera_make IS NULL AND (name LIKE 'Screenshot%' OR name LIKE 'Capture%' OR (name LIKE '%.PNG' AND (width, height) IN ((1080, 1920), (1920, 1080))))"),
    "q_nonfaces": (q_nonfaces, _with(MEDIA, FACES, PEOPLE) + "SELECT * FROM (SELECT f.id, f.person_id, CASE WHEN detection < 0.5 THEN 'low detection score' WHEN least(w, h) < 6 THEN 'too small' WHEN coalesce(quality, 0.5) < 0.3 THEN 'very low quality' END AS reason FROM faces f JOIN media m ON m.id = f.media_id AND m.deleted_at IS NULL LEFT JOIN people p ON p.id = f.person_id WHERE f.deleted_at IS NULL AND review_state = 'unreviewed' AND manual = 0 AND trim(coalesce(p.name, '')) = '') WHERE reason IS NOT NULL"),
    "q_usable_crops": (q_usable_crops, _with(FACES) + "SELECT id FROM faces WHERE least(w, h) >= 24 AND detection >= 0.65 AND quality >= 0.35"),
    "q_pending_quality": (q_pending_quality, _with(MEDIA, DONE) + "SELECT id FROM media LEFT JOIN done ON media_id = id WHERE deleted_at IS NULL AND missing = 0 AND status IN ('indexed', 'stale') AND (media_id IS NULL OR version < 2 OR computed_at < indexed_at)"),
    "q_pending_video": (q_pending_video, _with(MEDIA, DONE) + "SELECT id FROM media LEFT JOIN done ON media_id = id WHERE kind = 'video' AND deleted_at IS NULL AND missing = 0 AND status IN ('indexed', 'stale') AND (media_id IS NULL OR version < 2 OR model_key IS NULL)"),
    "q_sort_name": (q_sort_name, _with(MEDIA) + "SELECT id, name, (SELECT count(*) FROM media WHERE deleted_at IS NULL) AS total FROM media WHERE deleted_at IS NULL ORDER BY lower(name), id LIMIT 40 OFFSET 40"),
    "q_collapse_backlog": (q_collapse_backlog, _with(FACES, "o AS (SELECT * FROM faces WHERE review_state = 'unreviewed' AND deleted_at IS NULL AND manual = 0)", "r AS (SELECT id, row_number() OVER (PARTITION BY media_id, person_id ORDER BY coalesce(quality, 0) DESC, detection DESC, id) AS n FROM o WHERE person_id IS NOT NULL UNION ALL SELECT id, row_number() OVER (PARTITION BY media_id, track_id ORDER BY coalesce(quality, 0) DESC, detection DESC, id) FROM o WHERE person_id IS NULL AND track_id IS NOT NULL)") + "SELECT f.id, CASE WHEN r.n > 1 THEN 'confirmed' ELSE review_state END AS review_state FROM faces f LEFT JOIN r ON r.id = f.id"),
    "q_auto_confirm": (q_auto_confirm, _with(FACES) + "SELECT id, CASE WHEN deleted_at IS NULL AND review_state = 'unreviewed' AND manual = 0 AND person_id IS NOT NULL AND similarity >= 0.55 AND coalesce(quality, 0.5) >= 0.425 THEN 'confirmed' ELSE review_state END AS review_state FROM faces"),
    "q_review_no": (q_review_no, REVIEW + ", changed AS (SELECT * FROM chosen WHERE review_state <> 'rejected' OR manual <> 1), rejected AS (SELECT * FROM none UNION SELECT id, person_id FROM changed WHERE person_id IS NOT NULL), fresh AS (SELECT c.id AS face_id, c.person_id, 0 AS correct FROM changed c LEFT JOIN feedback b ON b.face_id = c.id WHERE c.person_id IS NOT NULL AND c.similarity IS NOT NULL AND (c.manual = 0 OR b.person_id = c.person_id)) SELECT id, " + STATE.format("rejected", 1, "FALSE") + " AS value, 'face' AS what FROM faces UNION ALL SELECT count(*), sum(person_id)::VARCHAR, 'rejections' FROM rejected UNION ALL SELECT face_id, person_id || ':' || correct, 'feedback' FROM (SELECT face_id, person_id, correct FROM fresh UNION ALL SELECT face_id, person_id, correct FROM feedback WHERE face_id NOT IN (SELECT face_id FROM fresh))"),
    "q_review_reset": (q_review_reset, REVIEW + "SELECT id, " + STATE.format("unreviewed", 0, "TRUE") + " AS value, 'face' AS what FROM faces UNION ALL SELECT face_id, person_id::VARCHAR, 'rejection' FROM none WHERE face_id NOT IN (SELECT id FROM chosen) UNION ALL SELECT face_id, correct::VARCHAR, 'feedback' FROM feedback WHERE face_id NOT IN (SELECT id FROM chosen)"),
    "q_representatives": (q_representatives, _with(FACES) + "SELECT person_id, id AS face_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY (review_state = 'confirmed') DESC, coalesce(quality, -1) DESC, detection DESC, id) AS r FROM faces WHERE person_id IS NOT NULL AND deleted_at IS NULL AND review_state <> 'rejected') WHERE r = 1"),
    "q_merge_people": (q_merge_people, _with(FACES, PEOPLE, "p AS (SELECT CASE WHEN person_id = 3 THEN 4 ELSE person_id END AS person_id, media_id FROM faces WHERE person_id IS NOT NULL)") + "SELECT 'exclusions' AS what, person_id AS id, count(DISTINCT media_id)::VARCHAR AS value FROM p GROUP BY 2 UNION ALL SELECT 'faces', person_id, count(*)::VARCHAR FROM p GROUP BY 2 UNION ALL SELECT 'name', id, CASE WHEN id = 4 AND trim(coalesce(name, '')) = '' THEN coalesce((SELECT nullif(trim(name), '') FROM people WHERE id = 3), name) ELSE name END FROM people WHERE id <> 3"),
    "q_move_faces": (q_move_faces, _with(FACES) + "SELECT id, CASE WHEN id % 7 = 0 THEN 2 ELSE person_id END AS person_id, CASE WHEN id % 7 = 0 THEN 1 ELSE manual END AS manual, CASE WHEN id % 7 = 0 THEN 'confirmed' ELSE review_state END AS review_state, CASE WHEN id % 7 <> 0 THEN round(similarity, 6) END AS similarity FROM faces"),
    "q_undo_move": (q_undo_move, _with(FACES) + "SELECT id, person_id, manual, review_state, round(similarity, 6) AS similarity FROM faces"),
    "q_set_favorite": (q_set_favorite, _with(MEDIA) + "SELECT id AS media_id, 'favorite' AS what FROM media WHERE (id % 6 = 0 OR id % 4 = 0) AND id % 10 <> 0 UNION ALL SELECT id, 'undo' FROM media WHERE id % 4 = 0 AND id % 6 <> 0"),
    "q_soft_delete": (q_soft_delete, _with(MEDIA) + "SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN deleted_at IS NULL AND id % 3 = 0 THEN '2025-05-05' ELSE deleted_at END AS deleted_at, CASE WHEN deleted_at IS NULL AND id % 3 = 0 THEN 1 END AS in_undo FROM media"),
    "q_album_remove": (q_album_remove, _with(ALBUM) + "SELECT * FROM album WHERE album_id <> 7 OR media_id % 2 <> 0"),
    "q_album_covers": (q_album_covers, _with(ALBUM, "a AS (SELECT album_id, CASE album_id % 3 WHEN 0 THEN min(media_id) + 1 WHEN 1 THEN min(media_id) END AS c, min(media_id) AS f FROM album GROUP BY 1)") + "SELECT album_id, CASE WHEN (album_id, c) IN (SELECT (album_id, media_id) FROM album) THEN c ELSE f END AS cover_media_id FROM a"),
    "q_event_merge": (q_event_merge, _with(MEMBERS) + "SELECT media_id, CASE WHEN event_id IN (4, 7, 8) THEN 4 ELSE event_id END AS event_id, CASE WHEN event_id IN (4, 7, 8) THEN 1 ELSE locked END AS locked FROM members"),
    "q_event_split": (q_event_split, _with(MEDIA, MEMBERS, "t AS (SELECT m.*, coalesce(captured_at, indexed_at) AS seen FROM members m JOIN media ON id = media_id)", "s AS (SELECT seen, media_id FROM t WHERE event_id = 7 ORDER BY media_id DESC LIMIT 1)") + "SELECT media_id, CASE WHEN event_id = 7 AND (seen, media_id) >= (SELECT (seen, media_id) FROM s) THEN 1000000 ELSE event_id END AS event_id, CASE WHEN event_id = 7 THEN 1 ELSE locked END AS locked FROM t"),
    "q_event_move": (q_event_move, _with(MEMBERS) + "SELECT media_id, CASE WHEN media_id % 50 = 0 THEN 7 ELSE event_id END AS event_id, CASE WHEN media_id % 50 = 0 OR event_id = 7 OR event_id IN (SELECT event_id FROM members WHERE media_id % 50 = 0) THEN 1 ELSE locked END AS locked FROM members"),
    "q_detection_window": (q_detection_window, _with(MEDIA, "e AS (SELECT o_custkey AS id, min(o_orderdate) AS start_at, max(o_orderdate) AS end_at FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)", "s AS (SELECT min(coalesce(captured_at, indexed_at)) - INTERVAL 48 HOURS AS lo, max(coalesce(captured_at, indexed_at)) + INTERVAL 48 HOURS AS hi FROM media WHERE id > (SELECT max(id) - 3 FROM media) AND deleted_at IS NULL HAVING count(*) > 0)") + "SELECT strftime(least(lo, (SELECT min(start_at) FROM e WHERE end_at >= lo AND start_at <= hi)), '%Y-%m-%d %H:%M:%S') AS lo, strftime(greatest(hi, (SELECT max(end_at) FROM e WHERE end_at >= lo AND start_at <= hi)), '%Y-%m-%d %H:%M:%S') AS hi FROM s"),
    "q_stable_ids": (q_stable_ids, None),
    "q_undoable": (q_undoable, "SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'undo' WHEN event_id % 4 = 1 AND event_id + 2 IN (SELECT event_id FROM events) THEN 'undone' ELSE 'done' END AS state FROM events"),
    "q_relink_report": (q_relink_report, _with(MEDIA, "s AS (SELECT id FROM media WHERE deleted_at IS NULL AND missing = 0 AND status = 'indexed' ORDER BY (id * 7919) % 1009, id LIMIT 60)") + "SELECT count(*) AS checked, count(*) FILTER (id % 3 <> 0 AND id % 5 <> 0) AS matched, round(100.0 * count(*) FILTER (id % 3 <> 0 AND id % 5 <> 0) / count(*), 1) AS match_percent FROM s"),
    "q_tracker_splits": (q_tracker_splits, "WITH s AS (SELECT l_suppkey AS p, l_orderkey % 500 AS m, l_linenumber * 5 + l_partkey % 3 AS t, l_suppkey % 50 AS x, l_partkey % 50 AS y, l_quantity / 5 AS z FROM lineitem) SELECT DISTINCT a.p AS a, b.p AS b FROM s a JOIN s b ON a.m = b.m AND a.p < b.p AND a.t <> b.t AND abs(a.t - b.t) <= 12 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.6 * greatest(a.z, b.z)"),
    "q_store_edits": (q_store_edits, _with(VERSIONS) + "SELECT id AS media_id, CASE WHEN hit THEN coalesce(v, 0) + 1 ELSE v END AS version, CASE WHEN hit THEN nr ELSE r END AS rating, CASE WHEN hit THEN 'Red' ELSE l END AS label, CASE WHEN hit THEN r END AS rating_before, CASE WHEN hit THEN 1 END AS in_history FROM j"),
    "q_revert_edits": (q_revert_edits, _with(VERSIONS) + "SELECT id AS media_id, CASE WHEN hit AND id % 9 = 0 THEN coalesce(v, 0) + 2 WHEN hit THEN coalesce(v, 0) + 1 ELSE v END AS version, CASE WHEN hit AND id % 9 <> 0 THEN nr ELSE r END AS rating, CASE WHEN hit AND id % 9 <> 0 THEN 'Red' ELSE l END AS label FROM j"),
    "q_cluster_samples": (q_cluster_samples, _with(FACES) + "SELECT person_id, id, place FROM (SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY review_state = 'confirmed' DESC, coalesce(quality, 0) DESC, detection DESC, id) AS place FROM faces WHERE person_id IS NOT NULL AND deleted_at IS NULL AND review_state <> 'rejected') WHERE place <= 5"),
    "q_package_identity": (q_package_identity, _with(MEDIA, "r AS (SELECT c_custkey AS rec, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey END AS content_hash, name, size, kind FROM customer JOIN media ON id = c_custkey)") + "SELECT rec, coalesce((SELECT min(id) FROM media m WHERE m.deleted_at IS NULL AND m.content_hash = r.content_hash), (SELECT min(id) FROM media m WHERE m.deleted_at IS NULL AND m.name = r.name AND m.size = r.size AND m.kind = r.kind AND (m.content_hash IS NULL OR r.content_hash IS NULL))) AS id FROM r"),
    "q_sidecar_owner": (q_sidecar_owner, _with(MEDIA) + "SELECT '/a/' || CASE WHEN id % 3 = 0 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') END || '.xmp' AS sidecar, id FROM media WHERE id % 5 < 3"),
    "q_review_breakdown": (q_review_breakdown, _with(MEDIA, FACES) + f"SELECT count(*) FILTER (similarity IS NULL) AS new_people, count(*) FILTER (similarity IS NOT NULL) AS low_confidence, count(*) FILTER (coalesce(quality, 0.5) < 0.35) AS low_quality FROM {LIVE} WHERE review_state = 'unreviewed'"),
    "q_cleanup_counts": (q_cleanup_counts, _with(MEDIA, FACES, f"o AS (SELECT * FROM {LIVE} WHERE review_state = 'unreviewed')") + "SELECT 'duplicates' AS what, count(*) FILTER (duplicate_count > 0) AS n FROM media WHERE deleted_at IS NULL UNION ALL SELECT 'failed', count(*) FROM media WHERE deleted_at IS NULL AND status = 'failed' UNION ALL SELECT 'missing', count(*) FROM media WHERE deleted_at IS NULL AND missing = 1 UNION ALL SELECT 'low_confidence', count(*) FROM o WHERE similarity < 0.5 UNION ALL SELECT 'unreviewed', count(*) FROM o UNION ALL SELECT 'deleted_faces', count(*) FROM faces WHERE deleted_at IS NOT NULL"),
    "q_library_counts": (q_library_counts, _with(MEDIA, FACES) + "SELECT count(*) FILTER (deleted_at IS NULL) AS media, count(*) FILTER (deleted_at IS NULL AND missing = 1) AS missing, count(*) FILTER (deleted_at IS NULL AND status = 'failed') AS failed, count(*) FILTER (deleted_at IS NOT NULL) AS deleted, coalesce(sum(size) FILTER (deleted_at IS NULL), 0)::BIGINT AS bytes, (SELECT count(*) FROM faces WHERE deleted_at IS NULL) AS faces, (SELECT count(*) FROM supplier) AS people FROM media"),
    "q_clutter": (q_clutter, _with(MEDIA) + "SELECT count(*) AS items, sum(size)::BIGINT AS bytes FROM media WHERE id % 3 = 0 OR id % 4 = 0 OR (deleted_at IS NULL AND missing = 0 AND kind = 'photo' AND camera_make IS NULL AND (name LIKE 'Screenshot%' OR name LIKE 'Capture%' OR (name LIKE '%.PNG' AND (width, height) IN ((1080, 1920), (1920, 1080)))))"),
    "q_hit_rate": (q_hit_rate, "SELECT event_type AS name, round(count(*) FILTER (value > 40) / greatest(count(*), 1), 6) AS rate FROM events GROUP BY 1"),
    "q_slowest_folders": (q_slowest_folders, "SELECT 'd' || user_id AS folder, count(*) AS files, round(sum(value), 3) AS seconds FROM events GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 10"),
    "q_memories_today": (q_memories_today, _with(MEDIA) + "SELECT year(captured_at) AS year, count(*) AS n FROM media WHERE deleted_at IS NULL AND strftime(captured_at, '%m-%d') = '06-15' AND year(captured_at) < 1997 AND coalesce(date_source, '') <> 'mtime' GROUP BY 1"),
    "q_next_job": (q_next_job, _with(JOBS) + "SELECT * FROM jobs WHERE status = 'queued' AND kind IN ('view', 'click') ORDER BY priority, id LIMIT 1"),
    "q_job_list": (q_job_list, _with(JOBS) + "SELECT id, status FROM jobs ORDER BY CASE WHEN status = 'done' THEN 1 ELSE 0 END, priority, id DESC LIMIT 50"),
    "q_feedback_samples": (q_feedback_samples, _with(MEDIA, FACES) + "SELECT f.id AS face_id, person_id, media_id, (review_state = 'confirmed')::INT AS correct, round(coalesce(quality, 0.5), 6) AS quality FROM faces f JOIN media m ON m.id = f.media_id WHERE person_id IS NOT NULL AND manual = 1 AND f.deleted_at IS NULL AND m.deleted_at IS NULL AND m.missing = 0 AND review_state <> 'unreviewed' AND detection BETWEEN 0 AND 1 ORDER BY f.id DESC LIMIT 4000"),
    "q_refused_vectors": (q_refused_vectors, f"WITH v AS (SELECT CASE WHEN vec_id % 10 = 9 THEN vec_id - 1 ELSE vec_id END AS key, vec_id FROM embeddings) SELECT key, CASE WHEN key <= 0 THEN 'id' WHEN key IN {TWICE} THEN 'repeated' WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 11 = 0 THEN 'zero' ELSE 'ok' END AS reason FROM v"),
    "q_sync_index": (q_sync_index, "WITH l AS (SELECT event_id * 7 % 400 AS key, arg_max(value < 30, event_id) AS gone FROM events WHERE event_id > 100 AND event_id <= 700 GROUP BY 1) SELECT vec_id AS key, -1 AS label FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id NOT IN (SELECT key FROM l) UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT key FROM l WHERE NOT gone)"),
    "q_index_gaps": (q_index_gaps, "SELECT vec_id AS key, 'missing' AS state FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 = 0 UNION ALL SELECT vec_id, 'extra' FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 = 0"),
    "q_backfill": (q_backfill, _with(MEDIA) + "SELECT id, coalesce(c_custkey % 3, 0) AS priority FROM media LEFT JOIN customer ON c_custkey = id WHERE deleted_at IS NULL AND missing = 0 AND id NOT IN (SELECT vec_id FROM embeddings) AND coalesce(c_custkey % 5, 0) < 3 ORDER BY coalesce(c_custkey % 3, 0) DESC, id DESC LIMIT 200"),
    "q_merge_preview": (q_merge_preview, "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), t AS (SELECT * FROM u WHERE label = 2 ORDER BY vec_id % 10 DESC, vec_id LIMIT 200), c AS (SELECT list(s ORDER BY p) AS c FROM (SELECT p, sum(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p FROM t) GROUP BY p)) SELECT vec_id AS face_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 4) AS similarity FROM u, c WHERE label = 1 ORDER BY list_dot_product(v, c), vec_id LIMIT 24"),
    "q_adjusted_similarity": (q_adjusted_similarity, _with(FACES) + "SELECT id, round(CASE WHEN q >= 0.75 THEN similarity WHEN similarity >= 0.5 THEN similarity - (0.75 - q) * 0.06 ELSE similarity - (0.75 - q) * 0.12 END, 6) AS s FROM (SELECT *, least(1.0, coalesce(quality, 0.5)) AS q FROM faces)"),
    "q_probability": (q_probability, _with(FACES) + "SELECT id, CASE WHEN similarity IS NULL THEN 0 ELSE round(1 / (1 + exp(-(4 * similarity + coalesce(quality, 0.5) + 0.5 * least(detection, 1) - 3))), 6) END AS p FROM faces"),
    "q_day_span": (q_day_span, "SELECT o_orderkey, CASE WHEN a::DATE = b THEN strftime(a, '%-d %b %Y') WHEN strftime(a, '%Y%m') = strftime(b, '%Y%m') THEN day(a) || '–' || strftime(b, '%-d %b %Y') WHEN year(a) = year(b) THEN strftime(a, '%-d %b') || ' – ' || strftime(b, '%-d %b %Y') ELSE strftime(a, '%-d %b %Y') || ' – ' || strftime(b, '%-d %b %Y') END AS days FROM (SELECT o_orderkey, o_orderdate AS a, (o_orderdate::DATE + (o_orderkey % 40)::INT) AS b FROM orders)"),
    "q_output_size": (q_output_size, _with(MEDIA, "s AS (SELECT id, CASE WHEN id % 4 IN (1, 3) THEN height ELSE width END AS w, CASE WHEN id % 4 IN (1, 3) THEN width ELSE height END AS h, id % 3 <> 0 AS cut, least(0.5, 1 - (id % 7) / 10.0) AS part FROM media)") + "SELECT id, CASE WHEN cut THEN greatest(1, round_even(w * 0.9, 0))::BIGINT ELSE w END AS width, CASE WHEN cut THEN greatest(1, round_even(h * round(part, 6), 0))::BIGINT ELSE h END AS height FROM s"),
}
