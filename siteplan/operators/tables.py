"""Attaching user-written table operators with a checked output schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def apply_operator(df: DataFrame, fn: Callable[..., DataFrame], out_schema: str | T.StructType, **params) -> DataFrame:
    """Run a user operator and check names and types of its columns before any job starts."""
    result = df.transform(fn, **params)
    wanted = T._parse_datatype_string(out_schema) if isinstance(out_schema, str) else out_schema
    found = [(f.name, f.dataType) for f in result.schema]
    expected = [(f.name, f.dataType) for f in wanted]
    if found != expected:
        raise TypeError(f"operator returned {found}, declared {expected}")
    return result
