"""Every query of the library with the SQL that checks it, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gossamer.plans import catalog, membership  # noqa: F401 (membership registers its queries in the catalog)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLE_SQL)
