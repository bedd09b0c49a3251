"""Every registered query with a SQL twin, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from galleon.plans import catalog
from galleon.plans.analytics import QUERIES as ANALYTICS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TWINS = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    os.environ["TZ"] = "UTC"
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", TWINS)
def test_against_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ordered(tuple(norm(r[c]) for c in columns) for r in df.collect()) == ordered(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(TWINS)))
def test_others_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_every_query_has_a_name_of_its_own():
    assert len(catalog.queries()) > 80 and "q_rrf" in ANALYTICS
