"""Column-level building blocks."""

from tidemark.functions.draws import hash_uniform, weighted_choice
from tidemark.functions.json_text import ends_there, is_one_value, may_go_on, one_object, one_variant
from tidemark.functions.once import computed_once
from tidemark.functions.partitions import (
    TIME_KEYS,
    partition_path,
    path_value,
    path_values,
    time_parts,
    zero_padded,
)
from tidemark.functions.typed_attributes import attribute_schema

__all__ = [
    "TIME_KEYS",
    "attribute_schema",
    "computed_once",
    "ends_there",
    "hash_uniform",
    "is_one_value",
    "may_go_on",
    "one_object",
    "one_variant",
    "partition_path",
    "path_value",
    "path_values",
    "time_parts",
    "weighted_choice",
    "zero_padded",
]
