"""Typed-attribute JSON, where every value is wrapped in its type tag: ``{"lat": {"N": "3494"}}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# Tag that marks a number; numbers travel as text.
NUMBER_TAG = "N"


def attribute_schema(fields: Sequence[str]) -> T.StructType:
    """Schema of the JSON that holds the given number attributes."""
    number = T.StructType([T.StructField(NUMBER_TAG, T.StringType())])
    return T.StructType([T.StructField(f, number) for f in fields])
