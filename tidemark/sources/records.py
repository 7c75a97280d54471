"""Record decoders on top of a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json_text import one_object
from tidemark.functions.once import computed_once
from tidemark.functions.typed_attributes import NUMBER_TAG, attribute_schema

# The change-record layout. An image maps attribute name to {type tag: text}.
CHANGE_RECORD_SCHEMA = (
    "struct<Records: array<struct<dynamodb: struct<"
    "NewImage: map<string, map<string, string>>, OldImage: map<string, map<string, string>>>>>>"
)


def decode_typed_attributes(df: DataFrame, col: str, fields: Sequence[str]) -> DataFrame:
    """Add one double column per number attribute found in the JSON text column ``col``.

    Missing or unreadable numbers are null.
    """
    parsed = df.withColumn("_attributes", F.from_json(F.col(col), attribute_schema(fields)))
    numbers = {f: F.col("_attributes").getField(f).getField(NUMBER_TAG).try_cast("double") for f in fields}
    return parsed.withColumns(numbers).drop("_attributes")


def scan_change_images(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """One row ``(new_image, old_image)`` per change record, an absent image is null; and the unreadable bodies.

    ``body`` is JSON text holding an array ``Records``; other columns are kept on both sides. A body
    without that array, or with text after its value, is unreadable and stays as it is. An empty
    array has no records and is no reject. Of a repeated key the last one counts.
    """
    keep = [c for c in df.columns if c != body]
    read = computed_once(df, "_records", one_object(F.col(body), CHANGE_RECORD_SCHEMA).getField("Records"))
    exploded = read.select(*keep, F.explode("_records").alias("_record"))
    images = exploded.select(
        *keep,
        F.col("_record.dynamodb.NewImage").alias("new_image"),
        F.col("_record.dynamodb.OldImage").alias("old_image"),
    )
    return images, read.filter(F.col("_records").isNull()).select(*keep, body)
