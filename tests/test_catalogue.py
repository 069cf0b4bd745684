import pytest
from oracle import same

from corpusmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, sf, name):
    same(spark, sf, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
