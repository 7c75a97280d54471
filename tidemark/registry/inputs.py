"""Inputs the tables do not hold as such, derived from whole tables by Spark.

Queries share landed copies: a copy is written once per session and data folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.partitions import TIME_KEYS, time_parts
from tidemark.session import scratch_dir
from tidemark.sinks.files import write_json_events

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
TEXT_PARTITIONS = T.StructType([T.StructField(k, T.StringType()) for k in TIME_KEYS])
TEXT_SCHEMA = T.StructType([T.StructField("value", T.StringType())])
LINE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

_landed: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed_copy(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a copy that ``write`` makes on first use."""
    key = (spark.conf.get("spark.app.id"), sf_dir, name)
    if key not in _landed:
        path = scratch_dir(spark, name)
        write(path)
        _landed[key] = path
    return _landed[key]


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    parts = [c.alias(k) for k, c in time_parts(F.col("ts")).items()]
    return table(spark, sf_dir, "events").select("event_id", text, "user_id", "event_type", "value", "props", *parts)


def landed_events(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as JSON lines below padded ``year=/month=/day=/hour=`` folders."""

    def write(path: str) -> None:
        # Hundreds of tiny folders: ranges of time and id let several tasks share them.
        rows = _event_rows(spark, sf_dir).repartitionByRange(32, *TIME_KEYS, "event_id")
        write_json_events(rows, path, list(TIME_KEYS))

    return landed_copy(spark, sf_dir, "landed_events", write)


def landed_records(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as JSON lines in one folder, as a stream delivers them."""

    def write(path: str) -> None:
        write_json_events(_event_rows(spark, sf_dir).select(*EVENT_SCHEMA.names), path)

    return landed_copy(spark, sf_dir, "landed_records", write)


def event_lines(events: DataFrame) -> DataFrame:
    """One text record per event; some have a wrong type, are not JSON, or have more text after the value."""
    number = F.col("event_id").cast("string")
    head = F.concat(F.lit('{"event_id":'), number, F.lit(',"event_type":"'), "event_type", F.lit('","value":'))
    kind = F.pmod("event_id", F.lit(7))
    good = F.concat(head, F.col("value").cast("string"), F.lit("}"))
    # Some repeat a key; the last one counts.
    good = F.when(F.pmod("event_id", F.lit(11)) == 4, F.concat(F.lit('{"event_type":"first","value":0.5,'), F.substr(good, F.lit(2)))).otherwise(good)
    line = (
        F.when(kind == 2, F.concat(good, good))
        .when(kind == 3, F.concat(head, F.lit('"oops"}')))
        .when(kind == 5, F.concat(F.lit("event "), number))
        .when(kind == 6, F.concat(good, F.lit(" tail")))
        .otherwise(good)
    )
    return events.select(line.alias("value"))


def landed_lines(spark: SparkSession, sf_dir: str) -> str:
    """:func:`event_lines` as text files."""

    def write(path: str) -> None:
        event_lines(table(spark, sf_dir, "events")).write.text(path)

    return landed_copy(spark, sf_dir, "landed_lines", write)


def landed_documents(spark: SparkSession, sf_dir: str) -> str:
    """Whole ``documents`` as CSV with a header; texts hold commas, quotes and line breaks."""

    def write(path: str) -> None:
        documents = table(spark, sf_dir, "documents")
        documents.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)

    return landed_copy(spark, sf_dir, "landed_documents", write)


UPLOADED = {"building": ["c_mktsegment", "c_nationkey", "c_custkey"]}
WHOLE_UPLOAD = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
# A value of a million characters.
LONG_VALUE = 1_000_000


def quoted_name(key: Column, name: Column) -> Column:
    """A name as uploads may write it: plain, with text after a closing quote, never closed, or very long."""
    kind = F.pmod(key, F.lit(5))
    return (
        F.when(F.pmod(key, F.lit(1000)) == 7, F.concat(F.lit('"'), F.repeat(F.lit(',""'), F.lit(LONG_VALUE)), F.lit('"')))
        .when(kind == 0, F.concat(F.lit('"'), name, F.lit('"x')))
        .when(kind == 1, F.concat(F.lit('"'), name, F.lit(", open")))
        .when(kind == 2, F.concat(name, F.lit('"y"')))
        .otherwise(name)
    )


def _write_lines(lines: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Text of a column as lines below its name as a header line, as they are; ``keys`` become folders."""
    writer = lines.write.mode("append").option("header", True).option("sep", "\u0001").option("quote", "")
    (writer.partitionBy(*keys) if keys else writer).csv(path)


def landed_uploads(spark: SparkSession, sf_dir: str) -> str:
    """``customer`` as one CSV upload folder per market segment, with three kinds of header."""

    def write(path: str) -> None:
        segment = F.lower("c_mktsegment").alias("segment")
        customer = table(spark, sf_dir, "customer").select("*", segment)
        groups = [(F.col("segment") == name, columns) for name, columns in UPLOADED.items()]
        groups.append((~F.col("segment").isin("automobile", *UPLOADED), WHOLE_UPLOAD))
        for chosen, columns in groups:
            rows = customer.filter(chosen).select(*columns, "segment").hint("rebalance", F.col("segment"))
            rows.write.mode("append").partitionBy("segment").option("header", True).csv(f"{path}/uploads")
        line = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted_name(F.col("c_custkey"), F.col("c_name")))
        lines = customer.filter(F.col("segment") == "automobile").select(line.alias("c_custkey,c_name"), "segment")
        _write_lines(lines, f"{path}/uploads", ["segment"])

    return landed_copy(spark, sf_dir, "landed_uploads", write)


def landed_ragged(spark: SparkSession, sf_dir: str) -> str:
    """``customer`` as CSV of key and name, where some rows have a third value and some the key only."""

    def write(path: str) -> None:
        key, kind = F.col("c_custkey").cast("string"), F.pmod("c_custkey", F.lit(7))
        name = quoted_name(F.col("c_custkey"), F.col("c_name"))
        more = F.when((kind == 0) & (F.pmod("c_custkey", F.lit(5)) != 1), F.lit("more"))
        line = F.concat_ws(",", key, F.when(kind != 1, name), more)
        _write_lines(table(spark, sf_dir, "customer").select(line.alias("c_custkey,c_name")), path)

    return landed_copy(spark, sf_dir, "landed_ragged", write)


def landed_types(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as JSON lines, each event type below a location of its own."""

    def write(path: str) -> None:
        rows = _event_rows(spark, sf_dir).repartitionByRange(32, "event_type", *TIME_KEYS, "event_id")
        write_json_events(rows, path, ["event_type", *TIME_KEYS])

    return landed_copy(spark, sf_dir, "landed_types", write)


def notices(documents: DataFrame) -> DataFrame:
    """A queue body per document: none, one or two records, some with a missing part."""
    kind = F.pmod("doc_id", F.lit(10))
    bucket = F.concat(F.lit("docs-"), F.col("lang"))

    def record(suffix: str) -> Column:
        key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(suffix))
        key = F.when(kind == 4, "").when(kind != 5, key)
        arn = F.when(kind != 3, F.concat(F.lit("arn:"), bucket))
        place = F.struct(bucket.alias("name"), arn.alias("arn")).alias("bucket")
        return F.struct(F.struct(F.struct(key.alias("key")).alias("object"), place).alias("s3"))

    one, two = F.array(record(".txt")), F.array(record(".txt"), record(".meta"))
    records = F.when(kind == 1, F.slice(one, 1, 0)).when(kind == 2, two).otherwise(one)
    message = F.when(kind != 0, F.to_json(F.struct(records.alias("Records"))))
    return documents.select("doc_id", F.to_json(F.struct(message.alias("Message"))).alias("body"))


def change_records(orders: DataFrame) -> DataFrame:
    """A change batch per order: inserts, then for some a change or a removal; some are unreadable."""

    def image(status: Column) -> Column:
        def tagged(tag: str, value: Column) -> Column:
            return F.struct(value.cast("string").alias(tag))

        return F.struct(
            tagged("N", F.col("o_orderkey")).alias("o_orderkey"),
            tagged("S", status).alias("status"),
            tagged("N", F.col("o_totalprice")).alias("total"),
        )

    now, before = image(F.col("o_orderstatus")), image(F.lit("N"))

    def record(new: Column | None, old: Column | None) -> Column:
        images = F.struct(
            (F.when(F.lit(False), now) if new is None else new).alias("NewImage"),
            (F.when(F.lit(False), now) if old is None else old).alias("OldImage"),
        )
        return F.struct(images.alias("dynamodb"))

    records = (
        F.when(F.col("o_orderstatus") == "O", F.array(record(now, None)))
        .when(F.col("o_orderstatus") == "F", F.array(record(before, None), record(now, before)))
        .otherwise(F.array(record(now, before), record(None, now)))
    )
    kind = F.pmod("o_orderkey", F.lit(17))
    body = (
        F.when(kind == 0, F.concat(F.lit("not json "), F.col("o_orderkey").cast("string")))
        .when(kind == 1, '{"Records":null}')
        .when(kind == 2, '{"Records":[]} tail')
        .when(kind == 3, F.concat(F.lit('{"Records":null,'), F.substr(F.to_json(F.struct(records.alias("Records"))), F.lit(2))))
        .otherwise(F.to_json(F.struct(records.alias("Records"))))
    )
    return orders.select("o_orderkey", body.alias("body"))


def predictions(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, prediction)``: each embedding element as a ``[class, score]`` pair, eight per class."""
    pair = F.transform(
        "embedding",
        lambda x, i: F.array((F.col("label") * 8 + F.pmod(i, F.lit(8))).cast("double"), F.abs(x.cast("double"))),
    )
    return embeddings.select("vec_id", pair.alias("prediction"))


def payloads(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, payload)``: predictions as base64 JSON inside base64 JSON; some are broken in three ways."""
    number = F.col("vec_id").cast("string")
    inner = F.base64(F.encode(F.to_json(F.struct("prediction")), "UTF-8"))
    outer = F.struct(
        F.concat(F.lit("fragment-"), number).alias("fragmentMetaData"),
        F.concat(F.lit("frame-"), number).alias("frameMetaData"),
        F.lit("camera").alias("streamName"),
        inner.alias("sageMakerOutput"),
    )
    kind = F.pmod("vec_id", F.lit(11))
    broken = F.when(kind == 0, "%%%").when(kind == 1, "a").when(kind == 2, "//4=")  # the last is no UTF-8
    payload = F.coalesce(broken, F.base64(F.encode(F.to_json(outer), "UTF-8")))
    return predictions(embeddings).select("vec_id", payload.alias("payload"))


def sha_uniform(row_id: Column, seed: int, draw: int) -> Column:
    """A draw that plain SQL can repeat: ten hex digits of one digest per row."""
    digest = F.sha2(F.concat_ws("-", row_id.cast("string"), F.lit(str(seed))), 256)
    bits = F.conv(F.substring(digest, 1 + 10 * draw, 10), 16, 10).cast("double")
    return (bits + 0.5) / float(2**40)
