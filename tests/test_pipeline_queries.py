import pytest
from oracle import compare

from quarrylens.queries import pipeline


@pytest.mark.parametrize("name", sorted(pipeline.QUERIES))
def test_equals_sql(spark, sf, name):
    assert compare(spark, sf, pipeline.QUERIES[name], pipeline.SQL[name]) > 0
