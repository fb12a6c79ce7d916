import pytest
from oracle import compare

from quarrylens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    assert compare(spark, sf, queries.QUERIES[name], queries.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
