"""Each registered query against its SQL on the smallest tables."""

import pytest

from gossamer import registry
from tests.conftest import SMALL, compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark, duck):
    compare(registry.queries()[name](spark, SMALL), duck.sql(registry.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(name, spark):
    rows = registry.queries()[name](spark, SMALL).collect()
    assert rows and all(r["bytes_out"] <= r["bytes_in"] + r["skipped"] for r in rows)
