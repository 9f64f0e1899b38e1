"""The named queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplet.plans import oracle
from ripplet.plans import queries as own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.ALL)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
