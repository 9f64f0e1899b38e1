"""Schemas of Arrow functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def to_arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a schema text."""
    return to_arrow_schema(StructType.fromDDL(ddl))
