import pytest

from loomspan.llm import queries
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_matches_sql(spark, sf, name):
    more, less = differences(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLE[name])
    assert not more and not less
