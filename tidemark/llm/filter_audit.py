"""How filters interact: what each removes, at every place of every order they may run in.

Documents come as a stream of files in micro-batches. Four filters depend on the text alone and make a bit mask. The
fifth removes copies of a text with a smaller id, which no single batch can tell: the state of a text holds its
smallest id so far and how the rows with it are counted. Each batch adds to the counters of parts and masks; when a
smaller id arrives, the rows that stood for the text so far are taken back from their counter and counted as copies.
"""

from __future__ import annotations

import json
from itertools import permutations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import saved
from tidemark.session import scratch_dir
from tidemark.sources import object_listing

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = [
    {"filter_order": "".join(order), "step": at + 1, "bit": 1 << FILTERS.index(letter), "before": before}
    for order in permutations(FILTERS)
    for at, letter in enumerate(order)
    for before in [sum(1 << FILTERS.index(x) for x in order[:at])]
]
N_ORDERS = len(ORDERS) // len(FILTERS)

COUNTERS = "part string, mask int, flags int, delta long"
# Rows of a text: those of a batch, or those with its smallest id so far.
TEXTS = "text_key binary, mask int, part string, flags int, least long, held long, added long, copies long"
# The labels are dealt over this many tasks more, for ids that many rows have.
SALTS = 8


class Thresholds(NamedTuple):
    """A: fewer words; B: smaller percent of distinct words; C: more percent of A-Z; D: any such mark."""

    words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    marks: str = "[#$%&*|]"


def failures(text: Column, limits: Thresholds = Thresholds()) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        F.size(words) < limits.words,
        100 * distinct.cast("long") < limits.distinct_percent * F.size(words).cast("long"),
        100 * capitals.cast("long") > limits.capital_percent * F.length(text).cast("long"),
        text.rlike(limits.marks),
    ]
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, flags): 1 for an id with quality 1, 2 for one with toxic 1, in any of its rows."""
    flags = F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flags.alias("flags"))


def arrivals(docs: DataFrame, flags: DataFrame, limits: Thresholds) -> DataFrame:
    """Documents per text, part and flags: all, those without an id, the least id and how often it comes.

    No text is shuffled, only its digest. Counts per id come first, so that a text of many copies is a row a task.
    The join is a sort-merge join by hint: Spark takes the salted labels for as small as their file, and would send
    all their copies through the driver.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"),
        failures(text, limits).alias("mask"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
    )
    spread = F.pmod(F.hash("text_key"), F.when(F.col("doc_id").isNull(), 1 << 20).otherwise(SALTS))
    salted = flags.select("*", F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("salt"))
    known = rows.withColumn("salt", spread).join(salted.hint("merge"), ["doc_id", "salt"], "left")
    known = known.withColumn("flags", F.coalesce("flags", F.lit(0)))
    of_id = known.groupBy("doc_id", "salt", "text_key", "mask", "part", "flags").agg(F.count("*").alias("n"))
    has_id = F.col("doc_id").isNotNull()
    of_text = of_id.groupBy("text_key", "mask", "part", "flags").agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(~has_id, F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    return of_text.select(
        *["text_key", "mask", "part", "flags", "documents", "without_id"],
        F.col("first.doc_id").alias("least"),
        F.coalesce("first.n", F.lit(0)).alias("at_least"),
    )


def updated(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state of all texts after a batch, and what the batch changes: rows of :data:`TEXTS`.

    ``held`` documents with the smallest id of their text stand in the counter of their mask. Those of a batch are
    ``added`` there or to the ``copies``. Where a smaller id has come, rows held so far are taken back from their
    counter and become copies. Rows without an id are no copies of others, nor are others copies of them.
    """
    zero = F.lit(0).cast("long")
    before = state.where("held > 0").select(
        *["text_key", "mask", "part", "flags", "least"],
        F.col("held").alias("at_least"),
        zero.alias("documents"),
        zero.alias("without_id"),
        F.lit(True).alias("old"),
    )
    both = before.unionByName(rows.withColumn("old", F.lit(False)))
    both = both.withColumn("smallest", F.min("least").over(Window.partitionBy("text_key")))
    stands = F.col("least").eqNullSafe(F.col("smallest"))
    held = F.when(stands, F.col("at_least")).otherwise(0)
    taken_back = F.when(F.col("old") & ~stands, F.col("at_least")).otherwise(0)
    fresh = F.when(F.col("old"), 0).otherwise(held + F.col("without_id"))
    return both.select(
        *["text_key", "mask", "part", "flags", "least"],
        held.alias("held"),
        (fresh - taken_back).alias("added"),
        (F.when(F.col("old"), 0).otherwise(F.col("documents") - held - F.col("without_id")) + taken_back).alias("copies"),
    )


def file_stream(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """Stream of the Parquet files at a path, a folder or one file, in about that many micro-batches."""
    size = object_listing(spark, path).agg(F.sum("length")).first()[0] or 0
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # As a pattern that matches itself, the path may also be that of one file.
    return reader.option("maxBytesPerTrigger", max(1, -(-size // batches))).parquet(f"{path[:-1]}[{path[-1]}]")


def count_masks(
    stream: DataFrame, labels: DataFrame, limits: Thresholds = Thresholds(), checkpoint: str | None = None
) -> DataFrame:
    """Documents per part, mask and label flags, once the stream has taken all there is.

    The state of the texts is a table, of which each batch writes the next version: one row per text, part and flags,
    joined by a shuffle on the text. Batches write to folders of their own from the version before, so that one that
    is run again leaves the same. With a ``checkpoint`` folder a later call goes on with the files that came since.
    """
    spark = stream.sparkSession
    root = checkpoint or scratch_dir(spark, "filter-audit")
    counters, texts = f"{root}/counters", f"{root}/texts"
    for path, schema in ((f"{counters}/batch=-1", COUNTERS), (f"{texts}/batch=-1", TEXTS)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    flags = saved(label_flags(labels), "label-flags")

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(TEXTS).parquet(f"{texts}/batch={number - 1}")
        now = f"{texts}/batch={number}"
        updated(before, arrivals(batch, flags, limits)).write.mode("overwrite").parquet(now)
        changes = F.inline(
            F.array(
                F.struct(F.col("mask"), F.col("added").alias("delta")),
                F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), F.col("copies").alias("delta")),
            )
        )
        changed = session.read.schema(TEXTS).parquet(now).where("added <> 0 OR copies <> 0")
        sums = changed.select("part", "flags", changes).groupBy("part", "mask", "flags").agg(F.sum("delta").alias("delta"))
        sums.write.mode("overwrite").parquet(f"{counters}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    sums = spark.read.schema(f"{COUNTERS}, batch long").parquet(counters)
    return sums.groupBy("part", "mask", "flags").agg(F.sum("delta").alias("n")).where("n <> 0")


def interactions(counts: DataFrame) -> DataFrame:
    """All orders of the filters and their steps, from documents ``n`` per part, mask and flags."""
    kind = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    steps = counts.select("*", F.inline(F.from_json(F.lit(json.dumps(ORDERS)), kind)))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier

    def documents(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    flagged = {bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0 for bit in (1, 2)}
    # Of the orders, a filter comes first among the k that a document fails in one of k.
    share = F.when(fails, F.col("n") * (F.lit(N_ORDERS) / F.bit_count("mask")).cast("long")).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        documents(~fails & ~earlier).alias("kept"),
        documents(removed).alias("removed"),
        documents(fails & earlier).alias("redundant"),
        documents(F.col("mask") == F.col("bit")).alias("unique_fails"),
        documents(removed & flagged[1]).alias("good_lost"),
        documents(removed & flagged[2]).alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )


def filter_audit(
    spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Counts per part, order and step for the documents at a path, read in ``batches`` micro-batches.

    Null texts are empty, null languages the part of the empty name. Rows of one id and text are no copies of each
    other, rows without an id neither are copies nor make any; repeated labels count as 1 if any is. Every part has a
    row for every order and step. Columns beyond id, text and language are not read; an empty table gives no rows.
    """
    return interactions(count_masks(file_stream(spark, path, batches), labels, limits))
