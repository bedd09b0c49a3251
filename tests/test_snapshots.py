import pytest
from pyspark.sql import functions as F

from galleon.sources import snapshots as op


def tables(spark, change=lambda df: df):
    media = spark.createDataFrame([(i, f"n{i}" if i % 7 else None, [i, i + 1], float(i)) for i in range(400)], "id long, name string, tags array<long>, size double")
    media = media.union(media.where("id < 5"))  # rows that repeat
    none = spark.createDataFrame([], "k long, v string")
    return {"media": (change(media), "id"), "empty": (none, "k")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_generations_are_incremental_and_restore(spark, tmp_path):
    at = str(tmp_path)
    first = tables(spark)
    assert op.take(first, at, 16) == (1, 16)
    assert op.take(tables(spark, lambda df: df.repartition(5).orderBy(F.desc("size"))), at, 16) == (2, 0)
    changed = tables(spark, lambda df: df.where("id <> 11").withColumn("name", F.when(F.col("id") == 200, "new").otherwise(F.col("name"))))
    number, written = op.take(changed, at, 16)
    assert number == 3 and 1 <= written <= 2
    for g, source in ((1, first), (2, first), (3, changed), (None, changed)):
        for name, (df, _) in source.items():
            back = op.restore(spark, at, name, g)
            assert rows(back) == rows(df) and back.schema == df.schema
    assert all(op.verify(spark, at, g).isEmpty() for g in (1, 2, 3))
    with pytest.raises(ValueError):
        op.restore(spark, at, "other")


def test_damage_and_torn_writes_are_seen(spark, tmp_path):
    at = str(tmp_path)
    op.take(tables(spark), at, 8)
    folders = sorted((tmp_path / "data" / "media").glob("_address=*"))
    for f in folders[0].glob("*"):
        f.unlink()
    part = next(folders[1].glob("part-*.parquet"))
    (folders[2] / part.name.replace("part-", "part-9")).write_bytes(part.read_bytes())  # rows of another bucket
    found = {(r.bucket, r.problem) for r in op.verify(spark, at).collect()}
    numbers = [int(f.name.removeprefix("_address=")[:6]) for f in folders]
    assert found == {(numbers[0], "missing"), (numbers[2], "other number of rows")}


def test_a_run_that_broke_off(spark, tmp_path):
    at = str(tmp_path)
    op.take(tables(spark), at, 8)
    more = tables(spark, lambda df: df.withColumn("size", F.col("size") + 1))
    op.take(more, at, 8)
    for f in (tmp_path / "manifest" / "_g=2").iterdir():
        f.unlink()
    assert op.generations(spark, at) == [1] and rows(op.restore(spark, at, "media")) == rows(tables(spark)["media"][0])
    assert op.take(more, at, 8)[0] == 2  # the same buckets, written over those left behind
    assert rows(op.restore(spark, at, "media")) == rows(more["media"][0]) and op.verify(spark, at).isEmpty()
