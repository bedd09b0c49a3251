import random
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from galleon.operators import names as op

WORDS = ["Café", "Straße", "STRASSE", "İstanbul", "Σίσυφος", "ΣΊΣΥΦΟΣ", "ﬁsh", "fish", "Ａbc", "abc", "가나", "...", ". .", "naïve.txt. ", "naïve.txt", "x"]


def variants(seed, n):
    r = random.Random(seed)
    return [(i, r.choice([str.upper, str.lower, str, lambda x: unicodedata.normalize("NFD", x), lambda x: unicodedata.normalize("NFC", x)])(r.choice(WORDS)) if r.random() < 0.95 else None) for i in range(n)]


def test_joins_and_groups_against_brute_force(spark):
    a, b = variants(0, 120), variants(1, 60)
    left, right = spark.createDataFrame(a, "i long, name string"), spark.createDataFrame(b, "j long, title string")
    joined = op.join_by_name(left, right, "name", "title")
    want = sorted((i, j) for i, x in a for j, y in b if x is not None and y is not None and op.fold(x) == op.fold(y))
    assert sorted((r.i, r.j) for r in joined.collect()) == want and joined.columns == ["i", "name", "j", "title"]
    assert op.join_by_name(left, right, "name", "title", "left_anti").count() == sum(x is None or all(y is None or op.fold(y) != op.fold(x) for _, y in b) for _, x in a)
    counts, groups = Counter(x for _, x in a if x is not None), {}
    for x, n in counts.items():
        groups.setdefault(op.fold(x), []).append((-n, x.encode(), x))
    got = {(r.name, r.spellings, r.n) for r in op.group_by_name(left, "name").collect()}
    assert got == {(min(g)[2], len(g), -sum(n for n, _, _ in g)) for g in groups.values()}


def test_case_and_composition_meet_by_collation(spark):
    rows = spark.createDataFrame([(1, "Café"), (2, "CAFÉ"), (3, "cafe"), (4, None)], "i long, name string")
    pairs = {(r.i, r.j) for r in op.join_by_name(rows, rows.select(F.col("i").alias("j"), F.col("name").alias("other")), "name", "other", collation="UNICODE_CI").collect()}
    assert pairs == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    assert {(r.spellings, r.n) for r in op.group_by_name(rows, "name", "UNICODE_CI").collect()} == {(2, 2), (1, 1)}


def test_one_shuffle_join(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame(variants(2, 20), "i long, name string")
        plan = op.join_by_name(rows, rows.select(F.col("name").alias("other")), "name", "other", collation="UNICODE_CI")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 2 and "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
