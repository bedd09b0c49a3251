"""Queries over whole tables, against brute force."""

import random

import numpy as np
import pytest

from galleon.plans import catalog


def joined(edges):
    """Node to the least node of its component, by union-find."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_over_all_line_items(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.randrange(300), r.randrange(150), r.randrange(90), float(r.randint(1, 50))) for _ in range(150)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = [(c.id, c.component) for c in catalog.queries()["q_components_all"](spark, str(tmp_path)).collect()]
    want = joined([(o, -1 - s) for o, s, _, _ in rows])
    assert len(found) == len(want) and dict(found) == want and len(set(want.values())) > 20


def test_neighbours_of_every_vector(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(230, 6)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j), k + 1) for i in range(len(v)) for k, j in enumerate(np.argsort(-s[i])[:5])}
    found = catalog.queries()["q_knn_join_all"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {(x.a, x.b, x.rank) for x in found} == want


def test_later_and_odd_rows_count(spark, tmp_path):
    run = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    save("documents", [(i, 2) for i in range(0, 1500, 3)], "doc_id long, n_chars long")
    save("customer", [(1, 5.0), (900, 6.0), (901, 7.0)], "c_custkey long, c_acctbal double")
    save("events", [(4, 1, 1.0, "view"), (5, 1, 2.0, "view"), (7, 901, 3.0, "purchase")], "event_id long, user_id long, value double, event_type string")
    save("lineitem", [(3, 8, 2, "N"), (5000, 8, 9, "R"), (5000, 7, 4, "A")], "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string")
    assert run("q_signature_all") == [("500:1000",)]
    assert [(r[0], r[1]) for r in run("q_cdc_latest_all")] == [(1, 2.0), (900, 6.0)]
    assert run("q_people_in_selection_all") == [(7, 1, 4, "A"), (8, 1, 9, "R")]
