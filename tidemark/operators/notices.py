"""File-arrival notices, change images and row events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json_text import one_object
from tidemark.functions.once import computed_once

# Layout of a queue body, of the notice inside it, and of a row event.
BODY_SCHEMA = "struct<Message: string, Records: string>"
NOTICE_SCHEMA = (
    "struct<Records: array<struct<s3: struct<object: struct<key: string>, "
    "bucket: struct<name: string, arn: string>>>>>"
)
EVENT_STATUS = "extracted"
EVENT_SCHEMA = "status string, headers string, data string, fields array<string>"


def unnest_notifications(
    df: DataFrame, body: str = "body", first_only: bool = False, keep_body: bool = False
) -> DataFrame:
    """One row ``(key, bucket, arn)`` per object named in a queue body; other columns are kept.

    The body is JSON whose ``Message`` is JSON again, or it is the notice itself. A body without a message or
    without records, or one that is not exactly one JSON value, gives one row of nulls,
    for the caller to reject. ``first_only`` takes just the first record of each notice.
    ``keep_body`` keeps the body too, so that a reject can be read again.
    """
    outer = one_object(F.col(body), BODY_SCHEMA)
    bare = lambda o: F.when(o.getField("Records").isNotNull(), F.col(body))
    message = F.get(F.transform(F.array(outer), lambda o: F.coalesce(o.getField("Message"), bare(o))), F.lit(0))
    records = one_object(F.col("_message"), NOTICE_SCHEMA).getField("Records")
    if first_only:
        records = F.slice(records, 1, 1)
    keep = [c for c in df.columns if keep_body or c != body]
    df = computed_once(df, "_message", message)
    return df.select(*keep, F.explode_outer(records).alias("_record")).select(
        *keep,
        F.col("_record.s3.object.key").alias("key"),
        F.col("_record.s3.bucket.name").alias("bucket"),
        F.col("_record.s3.bucket.arn").alias("arn"),
    )


def read_notices(df: DataFrame, body: str = "body", first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects with key, bucket and arn; and what names none, with the body as it came."""
    found = unnest_notifications(df, body, first_only, keep_body=True)
    kept, rejected = require_fields(found, ["key", "bucket", "arn"])
    return kept.drop(body), rejected


def distinct_notices(
    df: DataFrame, ts: str, within: str = "1 hour", body: str = "body", first_only: bool = False
) -> DataFrame:
    """Objects with key, bucket and arn, each once though queues get notices twice (wrapped and bare, or again).

    On a stream a notice counts as the same if it comes within the given time of the first, by ``ts``; what is kept
    for that is bounded by this time, and rows later than it are left out. On a batch all of one object are the same.
    """
    identity = ["key", "bucket", "arn"]
    kept, _ = require_fields(unnest_notifications(df, body, first_only), identity)
    if df.isStreaming:
        return kept.withWatermark(ts, within).dropDuplicatesWithinWatermark(identity)
    return kept.dropDuplicates(identity)


def require_fields(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split into rows with every field present and the rest. Empty text counts as present."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.filter(present), df.filter(~present)


def split_images(df: DataFrame, new: str = "new_image", old: str = "old_image") -> DataFrame:
    """Rows ``(kind, image)`` for each image a change record carries; other columns are kept."""
    keep = [c for c in df.columns if c not in (new, old)]
    images = F.stack(F.lit(2), F.lit("new"), F.col(new), F.lit("old"), F.col(old)).alias("kind", "image")
    return df.select(*keep, images).filter(F.col("image").isNotNull())


def row_to_event(df: DataFrame) -> DataFrame:
    """Every row as ``(status, headers, data, fields)``.

    ``data`` joins the values without quoting, so a comma inside a value is
    ambiguous there; ``fields`` holds the same values unjoined.
    """
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return df.select(
        F.lit(EVENT_STATUS).alias("status"),
        F.lit(",".join(df.columns)).alias("headers"),
        F.array_join(values, ",").alias("data"),
        values.alias("fields"),
    )
