"""Every query of the core that has SQL gives the SQL's rows."""

import importlib

import pytest

from tests.oracle import connect, differences

MODULES = [importlib.import_module(m) for m in ("loomspan.queries.quality", "loomspan.queries.operators", "loomspan.queries.catalogue", "loomspan.queries.research", "loomspan.queries.platform")]
CASES = [(k, m) for m in MODULES for k in m.ORACLE]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize(("name", "module"), CASES, ids=[c[0] for c in CASES])
def test_matches_sql(spark, con, sf, name, module):
    more, less = differences(spark, con, sf, module.QUERIES[name], module.ORACLE[name])
    assert not more and not less, f"{list(more)[:2]} {list(less)[:2]}"
