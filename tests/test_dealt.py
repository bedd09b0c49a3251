"""Tables dealt by their number of rows, so that no task's joins grow with the table."""

import pytest
from pyspark.sql import functions as F

from galleon.operators import library, windows
from galleon.plans import curation, upkeep

SF = "/root/testdata/sf0.001"


def test_parts_follow_the_rows(spark):
    assert windows.parts(spark.range(1000), 10) == 100
    assert windows.parts(spark.range(1001), 10) == 101
    assert windows.parts(spark.range(0), 10) == windows.parts(spark.range(5), 10) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("module", "name"), [(curation, "q_soft_delete"), (curation, "q_review_no"), (curation, "q_review_reset"), (upkeep, "q_saved_matches")])
def test_no_task_gets_more_than_its_part(spark, monkeypatch, module, name):
    """With parts for the rows, shuffles of narrow columns are not merged into a few tasks."""
    want = sorted(map(str, getattr(module, name)(spark, SF).collect()))
    monkeypatch.setattr(windows, "parts", lambda rows, each=0: 23)
    found = getattr(module, name)(spark, SF)
    assert found.rdd.getNumPartitions() >= 23 or "hashpartitioning(" in found._jdf.queryExecution().toString() and ", 23)" in found._jdf.queryExecution().toString()
    assert sorted(map(str, found.collect())) == want


def test_a_deletion_joins_once(spark):
    """State and undo come from one join with the ids, not from a join of the media with themselves."""
    media = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, "x")], "id long, deleted_at string").withColumn("size", F.col("id") * 2)
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,)], "id long")
    gone, undo = library.soft_delete(media, ids, True, "now")
    assert sorted(map(tuple, gone.collect())) == [(1, "now", 2), (2, "x", 4), (3, None, 6), (4, "x", 8)] and list(map(tuple, undo.collect())) == [(1, None)]
    back, undo = library.soft_delete(gone, ids, False)
    assert sorted(map(tuple, back.collect())) == [(1, None, 2), (2, None, 4), (3, None, 6), (4, "x", 8)] and sorted(map(tuple, undo.collect())) == [(1, "now"), (2, "x")]
    assert gone._jdf.queryExecution().analyzed().toString().count("Join ") == 1
