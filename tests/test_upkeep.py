"""The queries over kept state, whole tables against plain versions."""

from pyspark.sql import functions as F

from galleon.operators import events, postings, sequences
from galleon.plans import sequential, upkeep

from .test_assignment import brute as assigned
from .test_evidence import brute as suggested
from .test_postings import brute as searched
from .test_reconcile import brute as reconciled

SF = "/root/testdata/sf0.001"


def test_stemmed_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {i: "relating conditions " + t if i % 30 == 1 else t for i, t in docs.items() if i % 20}
    want = searched(docs.items(), postings.query_terms("Conditional relations of a clown", True), True, 10**6)
    want = sorted(((i, round(s, 6)) for i, s in want), key=lambda x: (-x[1], x[0]))[:50]
    assert [tuple(r) for r in upkeep.q_stemmed_search(spark, SF).collect()] == want


def test_assign_in_order(spark, monkeypatch):
    monkeypatch.setattr("tests.test_assignment.THRESHOLD", 0.36)
    faces = [tuple(r) for r in upkeep.faces_in_order(spark, SF).collect()]
    want, _ = assigned(faces, [], [], set(), set(), set())
    got = sorted(tuple(r) for r in upkeep.q_assign_in_order(spark, SF).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and len({p for _, p, _ in got}) > 20


def test_reconcile(spark):
    faces, protected = upkeep.people_to_reconcile(spark, SF)
    want = reconciled([tuple(r) for r in faces.collect()], 0.4, {r.person_id for r in protected.collect()}, [])[0]
    assert sorted(map(tuple, upkeep.q_reconcile(spark, SF).collect())) == want and len(want) > 3


def test_event_upkeep(spark):
    want = events.detect(sequential._items(spark, SF)).groupBy("user_id", "super", "event").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))
    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "n", "least").collect())
    assert rows(upkeep.q_event_upkeep(spark, SF)) == rows(want)


def test_stream_tracks(spark):
    rows = lambda df: sorted(tuple(r) for r in df.select("media_id", "id", "track").collect())
    assert rows(upkeep.q_stream_tracks(spark, SF)) == rows(sequences.track(sequential._detections(spark, SF)))


def test_merge_evidence(spark):
    rows = [tuple(r) for r in upkeep.suggested_faces(spark, SF).collect()]
    want, _ = suggested(rows, 0.48, set(), set(), 600, 60)
    got = upkeep.q_merge_evidence(spark, SF).collect()
    assert {(r.a, r.b) for r in got} == {x[:2] for x in want} and len(want) > 2


def test_package_import_does_not_depend_on_the_order_of_lines(spark, tmp_path):
    """Of lines that are alike but for their supplier, the package gives that of the least, wherever it stands; the library's own all stay."""
    lines = [(order, 1 + order % 7 if n % 2 else 9 - order % 7, 1 + n // 2, 10.5) for order in range(30) for n in range(6)]
    want = {}
    for order in range(30):
        mine = [x for x in lines if x[0] == order]
        for _, supplier, *_ in mine if order % 3 < 2 else [min(x for x in mine if x[2] == line) for line in (1, 2, 3)]:
            n, items, price = want.get(f"s{supplier}", (0, frozenset(), 0.0))
            want[f"s{supplier}"] = n + 1, items | {order}, price + order
    for name, rows in (("up", lines), ("down", lines[::-1])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        spark.range(30).select(F.col("id").alias("o_orderkey"), F.col("id").cast("double").alias("o_totalprice")).write.parquet(f"{at}/orders.parquet")
        spark.range(1, 10).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name")).write.parquet(f"{at}/supplier.parquet")
        assert {r["name"]: (r.n, r["items"], r.price) for r in upkeep.q_package_import(spark, at).collect()} == {k: (n, len(items), price) for k, (n, items, price) in want.items()}, name
