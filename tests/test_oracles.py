"""Every query against its SQL at sf0.01; the operators of the llm subpackage have their own tests."""

import pytest
from conftest import SF, rows_of

from lakeglass.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.select(*names).collect()) == rows_of(want.fetchall())
