"""Changes to a library as functions from tables to tables, with the inverse of each.

Every change takes the tables it touches and returns their new state, and an ``undo``
table that holds what is needed to take it back.  Nothing is updated in place: callers
write the results as the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import event_upkeep, graph, windows
from . import vectors as vectors_


def _flip(rows: DataFrame, changed: DataFrame, key: str, **values: Column) -> DataFrame:
    """The rows, with new values where the key is among the changed ones."""
    out = rows.join(changed.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    out = out.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()})
    return out.select(*rows.columns)


# --- reviews


def collapse_backlog(faces: DataFrame) -> DataFrame:
    """Faces with ``review_state``: of the unreviewed ones of one person (or, without a person, one track) in
    one item only the best stays in the queue, the others are confirmed.  Manual ones are left alone."""
    open_ = (F.col("review_state") == "unreviewed") & F.col("deleted_at").isNull() & (F.col("manual") == 0)
    grouped = open_ & (F.col("person_id").isNotNull() | F.col("track_id").isNotNull())
    track = F.when(F.col("person_id").isNull(), F.col("track_id"))
    best = F.row_number().over(Window.partitionBy("media_id", "person_id", track, grouped).orderBy(F.coalesce("quality", F.lit(0.0)).desc(), F.desc("detection"), F.asc("id")))
    rows = faces.withColumn("_rank", best)
    return rows.withColumn("review_state", F.when(grouped & (F.col("_rank") > 1), "confirmed").otherwise(F.col("review_state"))).drop("_rank")


def confirm_state(similarity: Column, quality: Column, threshold: float, min_quality: float = 0.35, floor: float = 0.25) -> Column:
    """confirmed where match and crop are good enough, else unreviewed; unknown quality counts as a half."""
    ok = (similarity >= threshold) & (F.coalesce(quality, F.lit(0.5)) >= max(floor, 0.85 * min_quality))
    return F.when(F.coalesce(ok, F.lit(False)), "confirmed").otherwise("unreviewed")


def auto_confirm(faces: DataFrame, threshold: float = 0.52, min_quality: float = 0.35) -> DataFrame:
    """Faces with live unreviewed automatic matches confirmed where they are good enough."""
    open_ = F.col("deleted_at").isNull() & (F.col("review_state") == "unreviewed") & (F.col("manual") == 0) & F.col("person_id").isNotNull()
    state = confirm_state(F.col("similarity"), F.col("quality"), threshold, min_quality, floor=0.2)
    return faces.withColumn("review_state", F.when(open_, state).otherwise(F.col("review_state")))


STATES = {"yes": "confirmed", "no": "rejected", "reset": "unreviewed"}


def review(faces: DataFrame, ids: DataFrame, decision: str, feedback: DataFrame, rejections: DataFrame, negatives: DataFrame) -> dict[str, DataFrame]:
    """A decision on faces (ids: id): their state, feedback, rejections and hard negatives; doing it twice changes nothing.

    A match score becomes feedback only if it was automatic, or was reviewed for the same
    person before.  ``undo`` holds the faces as they were.
    """
    state, manual = STATES[decision], int(decision != "reset")
    hit = F.col("_hit") & F.col("deleted_at").isNull() & ((F.col("review_state") != state) | (F.col("manual") != manual) | F.lit(decision == "reset"))
    marked = faces.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn("_hit", hit)
    changed = marked.where("_hit").select(*faces.columns)
    pair = changed.where("person_id is not null").select(F.col("id").alias("face_id"), "person_id", "similarity", "manual")
    others = feedback.join(changed.select(F.col("id").alias("face_id")), "face_id", "left_anti")
    if decision == "reset":
        new_feedback = others
    else:
        before = feedback.select("face_id", F.col("person_id").alias("_known"))
        trusted = (F.col("manual") == 0) | (F.col("_known") == F.col("person_id"))
        fresh = pair.join(before, "face_id", "left").where(F.col("similarity").isNotNull() & F.coalesce(trusted, F.lit(False)))
        fresh = fresh.select("face_id", "person_id", "similarity", F.lit(int(decision == "yes")).alias("correct"))
        new_feedback = feedback.join(fresh, "face_id", "left_anti").select("face_id", "person_id", "similarity", "correct").unionByName(fresh)
    keys = pair.select("face_id", "person_id").distinct()
    if decision == "no":
        rejections = rejections.unionByName(keys.join(rejections, ["face_id", "person_id"], "left_anti"))
        fresh = pair.select("face_id", "person_id", "similarity").dropDuplicates(["face_id", "person_id"])
        negatives = negatives.unionByName(fresh.join(negatives, ["face_id", "person_id"], "left_anti"))
    else:
        rejections = rejections.join(keys, ["face_id", "person_id"], "left_anti")
        negatives = negatives.join(keys, ["face_id", "person_id"], "left_anti")
    return {
        "faces": marked.withColumns({c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in (("review_state", state), ("manual", manual))}).select(*faces.columns),
        "feedback": new_feedback, "rejections": rejections, "negatives": negatives,
        "undo": changed.select("id", "person_id", "review_state", "manual"),
    }


def representatives(faces: DataFrame) -> DataFrame:
    """(person_id, face_id): confirmed before others, then quality, detection and the least id."""
    live = faces.where("person_id is not null and deleted_at is null and review_state <> 'rejected'").withColumn("_c", (F.col("review_state") == "confirmed").cast("int"))
    best = windows.best(live.select("person_id", "id", "_c", "quality", "detection"), ["person_id"], [F.col("_c"), F.coalesce("quality", F.lit(-1.0)), F.coalesce("detection", F.lit(-1.0)), -F.col("id")])
    return best.select("person_id", F.col("id").alias("face_id"))


# --- people


def merge_people(faces: DataFrame, people: DataFrame, exclusions: DataFrame, rejections: DataFrame, source: int, target: int) -> dict[str, DataFrame]:
    """One person's faces and constraints become another's; constraints that become equal are kept once.

    The target takes the source's name if it has none.
    """
    to = F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id"))
    name = F.nullif(F.trim("name"), F.lit(""))
    given = people.where(F.col("id") == source).select(F.lit(target).alias("id"), name.alias("_given"))
    kept = people.where(F.col("id") != source).join(given, "id", "left").withColumn("name", F.when(name.isNull(), F.coalesce("_given", "name")).otherwise(F.col("name"))).select(*people.columns)
    return {
        "faces": faces.withColumn("person_id", to), "people": kept,
        "exclusions": exclusions.withColumn("person_id", to).select(*exclusions.columns).dropDuplicates(),
        "rejections": rejections.withColumn("person_id", to).select(*rejections.columns).dropDuplicates(),
        "undo": faces.where(F.col("person_id") == source).select("id", "person_id"),
        "undo_people": people.where(F.col("id").isin(source, target)),
        "undo_exclusions": exclusions.where(F.col("person_id").isin(source, target)),
        "undo_rejections": rejections.where(F.col("person_id").isin(source, target)),
    }


def undo_merge(state: dict[str, DataFrame], done: dict[str, DataFrame], source: int, target: int) -> dict[str, DataFrame]:
    """The tables as they were before a merge, save for what changed elsewhere since."""
    both = F.col("person_id").isin(source, target)
    back = done["undo"].select("id", F.col("person_id").alias("_was"))
    faces = state["faces"].join(back, "id", "left").withColumn("person_id", F.coalesce("_was", "person_id")).select(*state["faces"].columns)
    out = {"faces": faces, "people": state["people"].where(~F.col("id").isin(source, target)).unionByName(done["undo_people"])}
    for t in ("exclusions", "rejections"):
        out[t] = state[t].where(~both).unionByName(done[f"undo_{t}"])
    return out


def move_faces(faces: DataFrame, ids: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """(faces, undo): faces (ids: id) moved by hand to a person, confirmed and without their old score."""
    undo = faces.join(ids.select("id").distinct(), "id", "left_semi").select("id", "person_id", "manual", "review_state", "similarity")
    moved = _flip(faces, undo, "id", person_id=F.lit(target).cast("long"), manual=F.lit(1), similarity=F.lit(None).cast("double"), review_state=F.lit("confirmed"))
    return moved, undo


def put_back(rows: DataFrame, undo: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the values that an ``undo`` table holds."""
    held = [c for c in undo.columns if c != key]
    out = rows.join(undo.select(F.col(key), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in held)), key, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in held}).select(*rows.columns)


# --- favourites, deletion, albums


def set_favorite(favorites: DataFrame, media: DataFrame, ids: DataFrame, favorite: bool) -> tuple[DataFrame, DataFrame]:
    """(favourites, undo): only items that change are in ``undo``; unknown items are passed over."""
    chosen = ids.select(F.col("id").alias("media_id")).distinct()
    if favorite:
        changed = chosen.join(favorites, "media_id", "left_anti").join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
        return favorites.unionByName(changed), changed
    return favorites.join(chosen, "media_id", "left_anti"), chosen.join(favorites, "media_id", "left_semi")


def soft_delete(media: DataFrame, ids: DataFrame, deleted: bool, stamp: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(media, undo): marks items deleted, or restores them; those already so are passed over."""
    alive = F.col("deleted_at").isNull()
    rows = media.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn("_hit", F.col("_hit") & (alive if deleted else ~alive))
    after = rows.withColumn("deleted_at", F.when(F.col("_hit"), F.lit(stamp if deleted else None).cast("string")).otherwise(F.col("deleted_at")))
    return after.select(*media.columns), rows.where("_hit").select("id", "deleted_at")


def remove_from_album(album: DataFrame, album_id: int, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(album, undo): members taken out; the others keep their positions."""
    gone = album.where(F.col("album_id") == album_id).join(ids.select(F.col("id").alias("media_id")).distinct(), "media_id", "left_semi")
    return album.join(gone.select("album_id", "media_id"), ["album_id", "media_id"], "left_anti").select(*album.columns), gone.select(*album.columns)


def album_covers(albums: DataFrame, members: DataFrame) -> DataFrame:
    """Albums (album_id, cover_media_id) with the first member for a cover where none is set or it is no member."""
    first = members.groupBy("album_id").agg(F.min_by("media_id", "position").alias("_first"))
    held = members.select("album_id", F.col("media_id").alias("cover_media_id"), F.lit(True).alias("_ok"))
    rows = albums.join(held, ["album_id", "cover_media_id"], "left").join(first, "album_id", "left")
    return rows.withColumn("cover_media_id", F.when(F.col("_ok"), F.col("cover_media_id")).otherwise(F.col("_first"))).select(*albums.columns)


# --- events


def merge_events(members: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(members, undo) of (media_id, event_id, locked): the events become the first one, locked against detection."""
    undo = members.where(F.col("event_id").isin(*ids)).select("media_id", "event_id", "locked")
    hit = F.col("event_id").isin(*ids)
    return members.withColumns({"locked": F.when(hit, 1).otherwise(F.col("locked")), "event_id": F.when(hit, ids[0]).otherwise(F.col("event_id"))}), undo


def split_event(members: DataFrame, media: DataFrame, event_id: int, first: int, new_id: int) -> tuple[DataFrame, DataFrame]:
    """(members, undo): everything of an event from ``first`` on, in time order, becomes a new event."""
    at = media.select(F.col("id").alias("media_id"), F.coalesce("captured_at", "indexed_at").alias("_at"))
    mine = members.where(F.col("event_id") == event_id)
    start = mine.where(F.col("media_id") == first).join(at, "media_id").select(F.struct("_at", "media_id").alias("_from"))
    rows = members.join(at, "media_id", "left").join(F.broadcast(start), F.col("event_id") == event_id, "left")
    late = (F.col("event_id") == event_id) & (F.struct("_at", "media_id") >= F.col("_from"))
    new = rows.withColumns({"locked": F.when(F.col("event_id") == event_id, 1).otherwise(F.col("locked")), "event_id": F.when(late, new_id).otherwise(F.col("event_id"))})
    return new.select(*members.columns), mine.select("media_id", "event_id", "locked")


def move_to_event(members: DataFrame, ids: DataFrame, event_id: int) -> tuple[DataFrame, DataFrame]:
    """(members, undo): items put into an event; that one and those they leave are locked."""
    chosen = ids.select(F.col("id").alias("media_id")).distinct()
    left = members.join(chosen, "media_id", "left_semi").select("event_id").distinct()
    touched = left.union(left.sparkSession.createDataFrame([(event_id,)], "event_id long")).distinct().withColumn("_hit", F.lit(True))
    undo = members.join(touched, "event_id", "left_semi").select("media_id", "event_id", "locked")
    rest = members.join(chosen, "media_id", "left_anti").join(touched, "event_id", "left").withColumn("locked", F.when(F.col("_hit"), 1).otherwise(F.col("locked")))
    moved = chosen.select("media_id", F.lit(event_id).cast("long").alias("event_id"), F.lit(1).alias("locked"))
    return rest.select("media_id", "event_id", "locked").unionByName(moved), undo


def detection_window(media: DataFrame, events: DataFrame, watermark: int, hours: int = 48) -> DataFrame:
    """(lo, hi): the time around media newer than the watermark, widened to the automatic events it touches; no row if there is none."""
    at = F.coalesce("captured_at", "indexed_at")
    span = media.where((F.col("id") > watermark) & F.col("deleted_at").isNull()).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo is not null")
    span = span.select((F.col("lo") - F.expr(f"interval {hours} hours")).alias("lo"), (F.col("hi") + F.expr(f"interval {hours} hours")).alias("hi"))
    auto = events.where("user_edited = 0")
    wide = auto.crossJoin(F.broadcast(span)).where("end_at >= lo and start_at <= hi").agg(F.min("start_at").alias("a"), F.max("end_at").alias("b"))  # one row of span
    return span.crossJoin(wide).select(F.least("lo", "a").alias("lo"), F.greatest("hi", "b").alias("hi"))


def stable_ids(found: DataFrame, current: DataFrame, events: DataFrame) -> DataFrame:
    """(scope, group, event_id, changed): events found anew keep the id of the automatic event that holds most of their items.

    ``found`` is (scope, group, media_id), groups numbered in time order within
    scopes; ``current`` is (media_id, event_id, locked).  Earlier groups choose first, an id
    goes to one group only, and ids that are new follow the greatest without holes, by scope and group.
    """
    auto = events.where("user_edited = 0").select(F.col("id").alias("event_id"))
    free = current.where("locked = 0").join(auto, "event_id", "left_semi").select("media_id", "event_id")
    place = F.struct("scope", "group").alias("place")
    votes = found.join(free, "media_id").groupBy(place, "event_id").agg(F.count(F.lit(1)).alias("votes"))
    chosen = event_upkeep.match_ids(votes).select("place.*", "event_id", "votes")
    size = graph.cut(found.groupBy("scope", "group").agg(F.count(F.lit(1)).alias("n")))
    held = current.groupBy("event_id").agg(F.count(F.lit(1)).alias("held"))
    top = events.agg(F.max("id")).first()[0] or 0
    new = event_upkeep.dense_ids(size.select("scope", "group").join(chosen, ["scope", "group"], "left_anti"), ["scope", "group"], top + 1, "new_id")
    rows = size.join(chosen, ["scope", "group"], "left").join(held, "event_id", "left").join(new, ["scope", "group"], "left")
    changed = F.col("votes").isNull() | (F.col("votes") != F.col("n")) | (F.col("held") != F.col("n"))
    return rows.select("scope", "group", F.coalesce("event_id", "new_id").cast("long").alias("event_id"), changed.alias("changed"))


# --- edits


EDIT = ("rotation", "rating", "label", "flag")


def store_edits(edits: DataFrame, new: DataFrame, source: str = "app") -> tuple[DataFrame, DataFrame]:
    """(edits, history): edits (media_id, version, rotation, rating, label, flag) with new values for some items.

    Only what differs counts: it gets the next version and a line of history (media_id,
    version, source, before, after), by which ``revert_edits`` takes it back.
    """
    now = new.select("media_id", *(F.col(c).alias(f"_{c}") for c in EDIT))
    rows = now.join(edits, "media_id", "left")
    differs = F.lit(False)
    for c in EDIT:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = rows.where(F.col("version").isNull() | differs)
    before = F.when(F.col("version").isNotNull(), F.struct(*EDIT))
    history = rows.select("media_id", (F.coalesce("version", F.lit(0)) + 1).cast("long").alias("version"), F.lit(source).alias("source"), before.alias("before"), F.struct(*(F.col(f"_{c}").alias(c) for c in EDIT)).alias("after"))
    stored = history.select("media_id", "version", *(F.col(f"after.{c}").alias(c) for c in EDIT))
    return edits.join(stored.select("media_id"), "media_id", "left_anti").select("media_id", F.col("version").cast("long").alias("version"), *EDIT).unionByName(stored), history


def revert_edits(edits: DataFrame, history: DataFrame) -> DataFrame:
    """Edits with a batch of history taken back, as a further version; items edited since stay as they are."""
    back = history.select("media_id", F.col("version").alias("_version"), "before")
    rows = edits.join(back, "media_id", "left")
    hit = F.col("_version") == F.col("version")
    values = [F.when(hit, F.col(f"before.{c}")).otherwise(F.col(c)).alias(c) for c in EDIT]
    return rows.select("media_id", (F.col("version") + F.coalesce(hit, F.lit(False)).cast("int")).cast("long").alias("version"), *values)


def cluster_samples(faces: DataFrame, n: int = 24) -> DataFrame:
    """The faces that stand for each person: confirmed first, then quality, detection and the least id, at most ``n``."""
    live = faces.where("person_id is not null and deleted_at is null and review_state <> 'rejected'")
    best = [(F.col("review_state") == "confirmed").desc(), F.coalesce("quality", F.lit(0.0)).desc(), F.desc("detection"), F.asc("id")]
    return windows.top_n(live, ["person_id"], best, n, "place").select("person_id", "id", F.col("place").cast("long").alias("place"))


# --- audit, relinking, packages, sidecars


def undoable(log: DataFrame) -> DataFrame:
    """(id, state) of entries of an audit log (id, action, undoes): done, undone or, for entries that undo, undo.

    An entry can be taken back once: a second attempt at an undone one finds it gone from ``done``.
    """
    taken = log.where("undoes is not null").select(F.col("undoes").alias("id"), F.lit(True).alias("_gone")).distinct()
    state = F.when(F.col("undoes").isNotNull(), "undo").when(F.col("_gone"), "undone").otherwise("done")
    return log.join(taken, "id", "left").select("id", state.alias("state"))


def relink(media: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """Media with their paths under a new root; those outside the old one stay."""
    head = old_root.rstrip("/") + "/"
    inner = F.substr("path", F.lit(len(head) + 1))
    return media.withColumn("path", F.when(F.startswith("path", F.lit(head)), F.concat(F.lit(new_root.rstrip("/") + "/"), inner)).otherwise(F.col("path")))


def relink_report(media: DataFrame, files: DataFrame, old_root: str, new_root: str, sample: int = 60) -> DataFrame:
    """(checked, matched, match_percent): how many of a fixed sample lie under the new root with their size and, within two seconds, time."""
    some = windows.pseudo_random(media.where("deleted_at is null and missing = 0 and status = 'indexed'"), "id", sample)
    f = files.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_time"))
    rows = relink(some, old_root, new_root).join(f, "path", "left")
    ok = (F.col("_size") == F.col("size")) & (F.abs(F.col("_time") - F.col("mtime_ns")) < 2_000_000_000)
    out = rows.agg(F.count(F.lit(1)).alias("checked"), F.count_if(ok).alias("matched"))
    return out.withColumn("match_percent", F.when(F.col("checked") > 0, F.round(100.0 * F.col("matched") / F.col("checked"), 1)).otherwise(100.0))


def package_identity(records: DataFrame, media: DataFrame) -> DataFrame:
    """(rec, id): the least live item with the record's content hash; else with its name, size and kind where either has no hash."""
    live = media.where("deleted_at is null")
    by_hash = live.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("_h"))
    shape = ["name", "size", "kind"]
    by_shape = live.groupBy(*shape).agg(F.min("id").alias("_any"), F.min(F.when(F.col("content_hash").isNull(), F.col("id"))).alias("_bare"))
    rows = records.join(by_hash, "content_hash", "left").join(by_shape, shape, "left")
    return rows.select("rec", F.coalesce("_h", F.when(F.col("content_hash").isNull(), F.col("_any")).otherwise(F.col("_bare"))).alias("id"))


def sidecar_owner(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """(sidecar, id): the item whose path is the sidecar's without its last extension, else the least id that has one extension more."""
    stem = F.regexp_replace("sidecar", r"(?<=[^/])\.[^./]*$", "")
    rows = sidecars.select("sidecar", stem.alias("stem"))
    exact = media.select(F.col("path").alias("stem"), "id").groupBy("stem").agg(F.min("id").alias("_exact"))
    # what precedes any dot of a path may be a stem
    cut = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.substr("path", i, F.lit(1)) == ".")
    loose = media.select("id", F.explode(F.transform(cut, lambda i: F.substr("path", F.lit(1), i - 1))).alias("stem")).groupBy("stem").agg(F.min("id").alias("_loose"))
    return rows.join(exact, "stem", "left").join(loose, "stem", "left").select("sidecar", F.coalesce("_exact", "_loose").alias("id"))


# --- counts


def live_faces(faces: DataFrame, media: DataFrame) -> DataFrame:
    return faces.where("deleted_at is null").join(media.where("deleted_at is null and missing = 0").select(F.col("id").alias("media_id")), "media_id", "left_semi")


def review_breakdown(faces: DataFrame, media: DataFrame) -> DataFrame:
    """(new_people, low_confidence, low_quality) of the faces still to be reviewed."""
    open_ = live_faces(faces, media).where("review_state = 'unreviewed'")
    return open_.agg(
        F.count_if(F.col("similarity").isNull()).alias("new_people"),
        F.count_if(F.col("similarity").isNotNull()).alias("low_confidence"),
        F.count_if(F.coalesce("quality", F.lit(0.5)) < 0.35).alias("low_quality"),
    )


def cleanup_counts(faces: DataFrame, media: DataFrame, review_threshold: float) -> DataFrame:
    """One row (what, n) for each kind of thing to clean up."""
    open_ = live_faces(faces, media).where("review_state = 'unreviewed'")
    parts = [
        media.where("deleted_at is null").agg(F.count_if(F.col("duplicate_count") > 0).alias("duplicates"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("missing") == 1).alias("missing")),
        open_.agg(F.count_if(F.col("similarity") < review_threshold).alias("low_confidence"), F.count(F.lit(1)).alias("unreviewed")),
        faces.agg(F.count_if(F.col("deleted_at").isNotNull()).alias("deleted_faces")),
    ]
    rows = [p.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, p.columns)), F.array(*map(F.col, p.columns)))).alias("what", "n")) for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def library_counts(media: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """(media, missing, failed, deleted, bytes, faces, people) of a library."""
    alive = F.col("deleted_at").isNull()
    m = media.agg(F.count_if(alive).alias("media"), F.count_if(alive & (F.col("missing") == 1)).alias("missing"), F.count_if(alive & (F.col("status") == "failed")).alias("failed"), F.count_if(~alive).alias("deleted"), F.coalesce(F.sum(F.when(alive, F.col("size"))), F.lit(0)).alias("bytes"))
    f, p = faces.agg(F.count_if(F.col("deleted_at").isNull()).alias("faces")), people.agg(F.count(F.lit(1)).alias("people"))
    return m.crossJoin(f).crossJoin(p)  # one row each


def clutter(categories: dict[str, DataFrame]) -> DataFrame:
    """(items, bytes) over candidates (id, size) of several categories, every item counted once."""
    every = None
    for df in categories.values():
        rows = df.select("id", "size")
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("id").agg(F.max("size").alias("size")).agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def hit_rate(cache: DataFrame) -> DataFrame:
    """(name, rate) of cache events (name, hit): hits over all, 0 without any."""
    g = cache.groupBy("name").agg(F.count_if(F.col("hit")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.select("name", F.round(F.col("hits") / F.greatest(F.col("n"), F.lit(1)), 6).alias("rate"))


def slowest_folders(folders: DataFrame, n: int = 10) -> DataFrame:
    return folders.orderBy(F.desc("seconds"), "folder").limit(n).select("folder", "files", F.round("seconds", 3).alias("seconds"))


def on_this_day(media: DataFrame, today: str) -> DataFrame:
    """(year, n) of live items taken on today's day in earlier years; dates guessed from files do not count."""
    day = F.lit(today).cast("date")
    taken = F.col("captured_at")
    rows = media.where(F.col("deleted_at").isNull() & (F.date_format(taken, "MM-dd") == F.date_format(day, "MM-dd")) & (F.year(taken) < F.year(day)) & (F.coalesce("date_source", F.lit("")) != "mtime"))
    return rows.groupBy(F.year(taken).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def next_job(jobs: DataFrame, kinds: list[str]) -> DataFrame:
    """The queued job to run: least priority, then least id."""
    return jobs.where((F.col("status") == "queued") & F.col("kind").isin(*kinds)).orderBy("priority", "id").limit(1)


def job_order() -> list[Column]:
    """Sort columns of a job list: active ones first, then by priority and the newest."""
    return [F.when(F.col("status").isin("running", "paused", "queued"), 0).otherwise(1).asc(), F.asc("priority"), F.desc("id")]


def feedback_samples(feedback: DataFrame, faces: DataFrame, media: DataFrame, limit: int = 4000) -> DataFrame:
    """The newest reviews fit for learning: by hand, of the person still set, in a state that says the same, all numbers in range."""
    live = media.where("deleted_at is null and missing = 0").select(F.col("id").alias("media_id"))
    f = faces.where("manual = 1 and deleted_at is null").select(F.col("id").alias("face_id"), F.col("person_id").alias("_p"), "media_id", "review_state", F.coalesce("quality", F.lit(0.5)).alias("quality"), "detection")
    rows = feedback.join(f, "face_id").where("person_id = _p").join(live, "media_id", "left_semi")
    rows = rows.where("(correct = 1 and review_state = 'confirmed') or (correct = 0 and review_state = 'rejected')")
    rows = rows.where(F.col("similarity").between(-1, 1) & F.col("quality").between(0, 1) & F.col("detection").between(0, 1))
    rows = rows.orderBy(F.desc("reviewed_at"), F.desc("face_id")).limit(limit)
    return rows.select("face_id", "person_id", "media_id", "similarity", "quality", "detection", "correct", "reviewed_at")


def fingerprint(rows: DataFrame, order: list[str]) -> DataFrame:
    """(fingerprint) of a bounded table, such as the samples of learning: it changes with any value."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    g = rows.select(F.struct(*order).alias("o"), F.sha2(line, 256).alias("h")).agg(F.array_sort(F.collect_list(F.struct("o", "h"))).alias("x"))
    return g.select(F.sha2(F.array_join(F.transform("x", lambda e: e["h"]), ""), 256).alias("fingerprint"))


# --- vectors of items


def valid_vectors(rows: DataFrame, dim: int, key: str = "key", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(valid, refused): ids must be positive and unique, vectors of ``dim`` finite numbers, not zero."""
    v = F.col(column)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    twice = rows.groupBy(key).count().where("count > 1").select(key, F.lit(True).alias("_twice"))
    marked = rows.join(twice, key, "left")
    reason = (
        F.when(F.col(key).isNull() | (F.col(key) <= 0), "id")
        .when(F.col("_twice"), "repeated")
        .when(v.isNull() | (F.size(v) != dim), "dimension")
        .when(~finite, "not finite")
        .when(length < 1e-12, "zero")
    )
    marked = marked.withColumn("reason", reason)
    unit = F.transform(v, lambda x: (x.cast("double") / length).cast("float"))
    good = marked.where("reason is null").withColumn(column, unit).select(*rows.columns)
    return good, marked.where("reason is not null").select(key, "reason")


def upsert(index: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """The index with new rows, and rows of known keys replaced."""
    return index.join(rows.select(key), key, "left_anti").select(*index.columns).unionByName(rows.select(*index.columns))


def sync_index(index: DataFrame, vectors: DataFrame, changes: DataFrame, after: int, through: int, key: str = "key") -> DataFrame:
    """The index after the changes (seq, key, deleted) in (after, through], each key as ``vectors`` now has it."""
    seen = changes.where((F.col("seq") > after) & (F.col("seq") <= through))
    last = seen.groupBy(key).agg(F.max_by("deleted", "seq").alias("_deleted"))
    alive = vectors.join(last.where("not _deleted"), key, "left_semi")
    return index.join(last.select(key), key, "left_anti").select(*index.columns).unionByName(alive.select(*index.columns))


def index_gaps(index: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """(key, state): keys that the index lacks, or has too many."""
    i, v = index.select(key), vectors.select(key)
    return v.join(i, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(i.join(v, key, "left_anti").withColumn("state", F.lit("extra")))


def stale_vectors(vectors: DataFrame, media: DataFrame, before: DataFrame, key: str = "key") -> DataFrame:
    """Vectors without those of items whose content hash has changed since ``before`` (id, content_hash)."""
    b = before.select("id", F.col("content_hash").alias("_was"))
    gone = media.join(b, "id").where(~F.col("content_hash").eqNullSafe(F.col("_was"))).select(F.col("id").alias(key))
    return vectors.join(gone, key, "left_anti")


def backfill(media: DataFrame, vectors: DataFrame, queue: DataFrame, limit: int, attempts: int = 3) -> DataFrame:
    """Live media without a vector, tried less than ``attempts`` times: by priority, newest id first."""
    q = queue.select(F.col("media_id").alias("id"), "attempts", "priority")
    rows = media.where("deleted_at is null and missing = 0").join(vectors.select(F.col("key").alias("id")), "id", "left_anti").join(q, "id", "left")
    rows = rows.where(F.coalesce("attempts", F.lit(0)) < attempts)
    return rows.orderBy(F.coalesce("priority", F.lit(0)).desc(), F.desc("id")).limit(limit).select("id", F.coalesce("priority", F.lit(0)).alias("priority"))


def merge_preview(faces: DataFrame, source: int, target: int, limit: int = 24, best: int = 200) -> DataFrame:
    """(face_id, similarity): the source's faces least like the target's centre (its best faces), to look at before merging."""
    live = faces.where("deleted_at is null")
    top = live.where((F.col("person_id") == target) & (F.col("review_state") != "rejected")).orderBy(F.desc("quality"), "id").limit(best)
    centre = vectors_.centroids(top, "person_id", digits=12).select(F.col("centroid"))
    rows = live.where(F.col("person_id") == source).crossJoin(F.broadcast(centre))  # one row
    return rows.select(F.col("id").alias("face_id"), F.round(vectors_.dot(F.col("embedding"), F.col("centroid")), 4).alias("similarity")).orderBy("similarity", "face_id").limit(limit)
