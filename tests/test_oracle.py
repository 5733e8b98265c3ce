"""What checks a query is SQL."""

import __spark_entry__ as entry


def test_oracles_are_sql():
    assert all(isinstance(x, str) and x.strip() for x in entry.oracle_sql().values())
