import numpy as np
from pyspark.sql import functions as F

from galleon.functions import plugins
from galleon.operators import integrity


def test_checksums_and_orphans(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [1.0], 2), (3, [float("nan"), 1.0], 2), (4, [0.5, 0.5], 2), (5, None, 2)], "key long, embedding array<double>, dim int")
    df = df.withColumn("sha256", F.when(F.col("key") == 4, "x").otherwise(F.sha2(F.to_json("embedding"), 256)))
    assert {(r.key, r.problem) for r in integrity.checksum_problems(df).collect()} == {(2, "size"), (3, "not finite"), (4, "checksum"), (5, "missing")}
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, media_id long")
    assert [r.id for r in integrity.orphans(child, spark.createDataFrame([(1,)], "id long"), "media_id").collect()] == [2]
    assert integrity.estimate(2, 10, 100) == 20 and integrity.estimate(0, 0, 5) == 0


def test_active_space(spark):
    models = spark.createDataFrame([("old", "text", 1, False, False), ("new", "text", 2, False, False), ("plug", "text", 3, False, True), ("v1", "visual", 1, False, False), ("v2", "visual", 2, False, False), ("p", "face", 1, True, True)], "model_key string, role string, created int, pinned boolean, plugin boolean")
    cov = spark.createDataFrame([("old", 1.0), ("new", 0.96), ("plug", 1.0), ("v1", 0.9), ("v2", 0.3)], "model_key string, coverage double")
    assert {tuple(r) for r in integrity.active_space(models, cov).select("role", "model_key").collect()} == {("text", "new"), ("visual", "v1"), ("face", "p")}


def test_plugins(spark):
    data = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"")), (3, None)], "id long, content binary")
    embed = plugins.embedder(lambda xs: [np.array([len(x), 1.0]) if x else 1 / 0 for x in xs], 2)
    got = {r.id: r.e for r in data.select("id", embed("content").alias("e")).collect()}
    assert got[1].error is None and abs(sum(v * v for v in got[1].vec) - 1) < 1e-6
    assert got[2].error.startswith("ZeroDivisionError") and got[3].error == "no content"
    labels = plugins.classifier(lambda xs: [[{"label": " Cat ", "score": 2}, {"label": "dog", "score": float("nan")}] for _ in xs])
    assert [(x.label, x.score) for x in data.where("id = 1").select(labels("content").alias("l")).first().l] == [("cat", 1.0)]
    plan = plugins.export_plan(data.select("id"), lambda r: [f"x/{r['id']}", "../up", "/abs"])
    assert {(r.id, r.path) for r in plan.collect()} == {(1, "x/1"), (2, "x/2"), (3, "x/3")}
    assert plugins.compatible("1.0") and not plugins.compatible("1.1") and not plugins.compatible("2")


def test_transitions(spark):
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate(["on", "on", "off", "off", "on"])], "id long, ts int, state string")
    assert [r.ts for r in integrity.transitions(df, "id", "ts", "state").orderBy("ts").collect()] == [0, 2, 4]
