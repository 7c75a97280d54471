"""Labelled rows: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_column: str) -> Column:
    """True for ids whose checksum is divisible by 5: these are for testing only. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """One row (id, label 0 or 1) per id that may be learned from; the larger of repeated labels."""
    rows = labels.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.where(F.col(id_column).isNotNull() & F.col("label").isin(0, 1) & ~held_out(id_column))
    return rows.groupBy(id_column).agg(F.max("label").alias("label"))


def sampled_texts(
    docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, per_class: int, max_bytes: int
) -> DataFrame:
    """Columns (label, text) of at most ``per_class`` labelled documents of each class.

    Those with the smallest hash of the id are taken, among ids that have a text of at most ``max_bytes``
    bytes, so that the sample is bounded and the same in every run. An id takes part once, with the least of such texts.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.octet_length("text") <= max_bytes)
    known = training_labels(labels, id_column, label).join(rows.select(id_column).distinct(), id_column)
    order = [F.xxhash64(id_column), F.col(id_column)]
    chosen = known.where("label = 0").orderBy(*order).limit(per_class)
    chosen = chosen.union(known.where("label = 1").orderBy(*order).limit(per_class))
    # The sample has a proven bound, so that it may be sent to every executor.
    found = rows.join(F.broadcast(chosen), id_column)
    return found.groupBy(id_column, "label").agg(F.min("text").alias("text")).select("label", "text")
