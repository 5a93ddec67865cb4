"""Registered queries of the engine against their DuckDB twins on the smallest tables."""

import os

import pytest

from siltstone.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    result = duck.execute(Q.ORACLE_SQL[name])
    have = [c[0] for c in result.description]
    want = [tuple(dict(zip(have, r, strict=True))[c] for c in names) for r in result.fetchall()]
    assert sorted(have) == names
    assert ordered(tuple(r[c] for c in names) for r in got.collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_the_training_data_part():
    import __spark_entry__

    assert set(Q.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_khop_edges_gives_every_edge(spark, duck):
    got = Q.QUERIES["khop_edges"](spark, SF).select("source", "target", "weight")
    want = duck.execute(f"{Q.KHOP_SQL} SELECT source, target, weight FROM hop").fetchall()
    assert len({r[:2] for r in want}) == len(want) > len({r[0] for r in want})
    assert ordered(map(tuple, got.collect())) == ordered(want)
