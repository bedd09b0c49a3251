import pytest

from galleon.sources import packages as op

SCHEMAS = {
    "media": "id long, content_hash string, name string",
    "people": "id long, name string",
    "faces": "id long, media_id long, person_id long, bbox array<double>, quality double",
    "albums": "id long, name string, cover_id long",
    "album_items": "album_id long, media_id long, position int",
    "edits": "media_id long, rating int",
}
LIB = {
    "media": [(10, "h1", "a"), (20, "h2", "b"), (30, None, "c"), (31, None, "c")],
    "people": [(5, "Ann"), (7, "Bob"), (9, None)],
    "faces": [(100, 10, 5, [1.0, 2.0], 0.5), (101, 20, 7, [3.0, 4.0], None), (102, 30, None, [5.0, 6.0], 0.1), (103, 31, 9, None, 0.9)],
    "albums": [(1, "Best", 20), (2, "None", None)],
    "album_items": [(1, 10, 0), (1, 20, 1), (2, 30, 0)],
    "edits": [(10, 5), (30, 3)],
}


def tables(spark, rows=LIB):
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


def told(t):
    """Everything a library says, without its keys."""
    rows = {n: [r.asDict() for r in df.collect()] for n, df in t.items()}
    media = {r["id"]: (r["content_hash"], r["name"]) for r in rows["media"]}
    people = {r["id"]: r["name"] for r in rows["people"]}
    albums = {r["id"]: (r["name"], media.get(r["cover_id"])) for r in rows["albums"]}
    faces = [(media[r["media_id"]], people.get(r["person_id"]), r["bbox"], r["quality"]) for r in rows["faces"]]
    items = [(albums[r["album_id"]], media[r["media_id"]], r["position"]) for r in rows["album_items"]]
    edits = [(media[r["media_id"]], r["rating"]) for r in rows["edits"]]
    return [sorted(map(str, x)) for x in (media.values(), people.values(), albums.values(), faces, items, edits)]


@pytest.mark.parametrize("policy", op.POLICIES)
def test_export_import_export_is_the_same_up_to_keys(spark, tmp_path, policy):
    op.export(tables(spark), str(tmp_path / "a"))
    got = op.merge(op.read(spark, str(tmp_path / "a")), tables(spark, {}), policy)
    assert told(got.tables) == told(tables(spark)) and not any(got.dropped.values())
    assert sorted(r.id for r in got.tables["media"].collect()) == [1, 2, 3, 4]
    op.export(got.tables, str(tmp_path / "b"))
    assert told(op.read(spark, str(tmp_path / "b"))) == told(tables(spark))


def test_policies(spark):
    other = dict(LIB, media=[(1, "h1", "renamed"), (2, "h9", "new"), (3, "h9", "again")], people=[(1, "Ann"), (2, "Cid")], faces=[(1, 1, 1, [1.0, 2.0], 0.8), (2, 3, 2, [9.0, 9.0], 0.7), (3, 99, 1, [0.0, 0.0], 0.2)], albums=[(4, "Best", 2)], album_items=[(4, 1, 7), (4, 3, 8)], edits=[(1, 1), (2, 2)])
    mine, theirs = tables(spark), tables(spark, other)
    skip = op.merge(theirs, mine, "skip")
    assert skip.dropped == {"media": 0, "people": 0, "faces": 1, "albums": 0, "album_items": 0, "edits": 0}
    assert {r.id: (r.content_hash, r.name) for r in skip.tables["media"].collect()} == {10: ("h1", "a"), 20: ("h2", "b"), 30: (None, "c"), 31: (None, "c"), 32: ("h9", "new")}
    assert {(r.old, r.new) for r in skip.keys["media"].collect()} == {(1, 10), (2, 32), (3, 32)}
    assert {(r.id, r.media_id, r.person_id, r.quality) for r in skip.tables["faces"].where("id in (100, 104)").collect()} == {(100, 10, 5, 0.5), (104, 32, 10, 0.7)}
    assert {(r.album_id, r.media_id, r.position) for r in skip.tables["album_items"].collect()} == {(1, 10, 0), (1, 20, 1), (2, 30, 0), (1, 32, 8)}
    assert {(r.media_id, r.rating) for r in skip.tables["edits"].collect()} == {(10, 5), (30, 3), (32, 2)}
    over = op.merge(theirs, mine, "overwrite")
    assert {r.id: r.name for r in over.tables["media"].collect()} == {10: "renamed", 20: "b", 30: "c", 31: "c", 32: "new"}
    assert {(r.id, r.quality) for r in over.tables["faces"].where("media_id = 10").collect()} == {(100, 0.8)}
    assert {(r.media_id, r.rating) for r in over.tables["edits"].collect()} == {(10, 1), (30, 3), (32, 2)}
    assert {(r.id, r.cover_id) for r in over.tables["albums"].collect()} == {(1, 32), (2, None)}
    both = op.merge(theirs, mine, "keep_both")
    assert sorted(r.id for r in both.tables["media"].collect()) == [10, 20, 30, 31, 32, 33, 34] and both.tables["people"].count() == 5
    again = op.merge(theirs, skip.tables, "skip")
    assert told(again.tables) == told(skip.tables)


def test_packages_and_versions_are_whole_or_not_there(spark, tmp_path):
    at = str(tmp_path / "p")
    op.export(tables(spark), at)
    for f in (tmp_path / "p" / "faces").glob("part-*"):
        f.unlink()
        break
    with pytest.raises(ValueError, match="faces"):
        op.read(spark, at)
    with pytest.raises(ValueError, match="no complete package"):
        op.read(spark, str(tmp_path / "none"))
    lib = str(tmp_path / "lib")
    assert op.commit(tables(spark), lib) == 1 and op.commit(op.merge(tables(spark), op.current(spark, lib), "keep_both").tables, lib) == 2
    assert op.current(spark, lib)["media"].count() == 8
    for f in (tmp_path / "lib" / "v000002" / "manifest").iterdir():
        f.unlink()
    assert told(op.current(spark, lib)) == told(tables(spark)) and op.commit(tables(spark), lib) == 2


def test_circles(spark):
    with pytest.raises(ValueError, match="circle"):
        op.in_order({"a": op.Entity("id", {"b": "b"}, ()), "b": op.Entity("id", {"a": "a"}, ())})
    with pytest.raises(ValueError, match="policy"):
        op.merge({}, tables(spark), "other")
