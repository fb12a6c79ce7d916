import pytest
from oracle import compare

from quarrylens.queries import index

#: Whose result may be empty on the smallest data.
MAY_BE_EMPTY = {"alias_pairs"}


@pytest.mark.parametrize("name", sorted(index.SQL))
def test_equals_sql(spark, sf, name):
    n = compare(spark, sf, index.QUERIES[name], index.SQL[name])
    assert n > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(index.QUERIES) - set(index.SQL)))
def test_runs(spark, sf, name):
    df = index.QUERIES[name](spark, sf)
    assert df.columns and (df.count() > 0 or name in MAY_BE_EMPTY)
