import pytest
from oracle import same

import __spark_entry__ as entry
from sparrel.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_duckdb(spark, small, name):
    same(entry.queries()[name](spark, small), core.SQL[name], small)


def test_entry(spark):
    queries = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert entry.entry(spark).count() == 10 * queries


def test_names():
    assert set(core.SQL) == set(core.QUERY_FNS)
    assert set(entry.oracle_sql()) <= set(entry.queries())
