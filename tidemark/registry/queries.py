"""One query per operator. Each takes ``(spark, sf_dir)`` and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import operators as ops
from tidemark import plans, sinks, sources, streaming
from tidemark.functions import TIME_KEYS, partition_path, time_parts
from tidemark.registry import inputs
from tidemark.registry.inputs import EVENT_SCHEMA, LINE_SCHEMA, TEXT_PARTITIONS, table
from tidemark.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _ntz(col: str) -> Column:
    return F.col(col).cast("timestamp_ntz").alias(col)


def _wide(df: DataFrame, *cols: str) -> DataFrame:
    """Whole numbers as the type SQL gives date parts."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _raw_events(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    path = inputs.landed_events(spark, sf_dir)
    return sources.scan_partitioned_json(spark, path, EVENT_SCHEMA, TEXT_PARTITIONS, **options)


# Scans and sources


@_query
def scan_partitioned_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_events(spark, sf_dir)


@_query
def scan_inferred_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "inferred")
    _events(spark, sf_dir).select(F.col("props").alias("value")).write.text(path)
    df = sources.scan_inferred_json(spark, path)
    return df.groupBy("k").agg(F.count("*").alias("n"), F.lit(",".join(df.columns)).alias("fields"))


@_query
def scan_csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.scan_csv_header(spark, inputs.landed_documents(spark, sf_dir), multi_line=True)


@_query
def scan_headed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over many lines, in files that are split; the header is that of each file."""
    rows = sources.scan_headed_files(spark, inputs.landed_documents(spark, sf_dir), multi_line=True)
    names = ("doc_id", "text", "lang", "source", "n_chars")
    return rows.select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)], "headers")


@_query
def scan_ragged_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.scan_csv_header(spark, inputs.landed_ragged(spark, sf_dir), ragged="all_values")
    return rows.withColumn("all_values", F.array_join("all_values", "|"))


def _drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON per day, with a field that some days lack and one whose type changes."""
    day, number = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id").cast("string")
    odd = F.pmod(F.dayofmonth("ts"), F.lit(2)) == 1
    mixed = F.when(odd, number).otherwise(F.concat(F.lit('"'), number, F.lit('"')))
    real = F.when(odd, number).otherwise(F.concat(number, F.lit(".5")))
    more = F.when(odd, F.lit("")).otherwise(F.lit(',"more":{"x":[1]}'))
    text = F.concat(F.lit('{"id":'), number, F.lit(',"mixed":'), mixed, F.lit(',"real":'), real, more, F.lit(',"none":null}'))
    return _events(spark, sf_dir).select(day.alias("day"), text.alias("json"))


@_query
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.field_types(_drifting(spark, sf_dir), "json", ["day"])


@_query
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.schema_drift(ops.field_types(_drifting(spark, sf_dir), "json", ["day"]), ["day"])


@_query
def decode_typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lng = F.when(F.col("s_nationkey") == 1, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    text = F.to_json(
        F.struct(
            F.struct((F.col("s_suppkey") * 3).cast("string").alias("N")).alias("lat"),
            F.struct(lng.alias("N")).alias("lng"),
        )
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(F.col("s_nationkey") != 0, text).alias("map")
    )
    return sources.decode_typed_attributes(suppliers, "map", ["lat", "lng"]).select("s_suppkey", "lat", "lng")


@_query
def scan_change_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, unreadable = sources.scan_change_images(inputs.change_records(table(spark, sf_dir, "orders")))
    read = images.select(
        "o_orderkey",
        F.col("new_image")["status"]["S"].alias("new_status"),
        F.col("new_image")["total"]["N"].try_cast("double").alias("new_total"),
        F.col("old_image")["status"]["S"].alias("old_status"),
    )
    return read.unionByName(unreadable.withColumnRenamed("body", "failed_text"), allowMissingColumns=True)


def _drained(spark: SparkSession, stream: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream until its input is used up and read what it wrote."""
    path, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-checkpoint")
    streaming.stream_to_parquet(stream, path, checkpoint, keys, available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.stream_source(
        spark, inputs.landed_records(spark, sf_dir), EVENT_SCHEMA, max_bytes=streaming.BUFFER_BYTES
    )


@_query
def stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, _event_stream(spark, sf_dir), "stream_source")


@_query
def stream_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the folders from 36 hours before the last one, in bounded batches; older folders are not listed."""
    last = _events(spark, sf_dir).agg(F.max("ts")).first()[0]
    schema = T.StructType(EVENT_SCHEMA.fields + TEXT_PARTITIONS.fields)
    stream = streaming.stream_source(
        spark,
        inputs.landed_events(spark, sf_dir),
        schema,
        max_bytes=streaming.BUFFER_BYTES,
        arrival_keys=tuple(TIME_KEYS),
        since=last - timedelta(hours=36),
    )
    return _drained(spark, stream, "stream_since")


# Sinks


@_query
def land_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed in batches; days before the 10th are closed and compacted, the others are read as they came."""
    root = scratch_dir(spark, "land_sized")
    stream = streaming.stream_source(spark, inputs.landed_records(spark, sf_dir), EVENT_SCHEMA, max_files=1)
    stream = ops.time_partition_columns(stream, "ts")
    keys = ("year", "month", "day")
    streaming.land_sized(stream, f"{root}/out", f"{root}/checkpoint", keys, available_now=True).awaitTermination()
    streaming.compact_landed(spark, f"{root}/out", stream.schema, keys, F.col("day") < "10")
    return streaming.read_landed(spark, f"{root}/out", stream.schema, keys)


@_query
def try_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customers become known from round to round; some never are, some are repaired after the first."""
    path = scratch_dir(spark, "ledger")
    kind = F.pmod("o_orderkey", F.lit(20))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("right"))
    broken = F.when(kind == 0, F.lit(None)).when(kind == 1, -1).otherwise(F.col("right")).alias("customer")
    fresh = orders.select("o_orderkey", broken)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))

    def attempt(number: int) -> Callable[[DataFrame], DataFrame]:
        known = customers.filter(F.pmod("customer", F.lit(3)) < number).withColumn("_known", F.lit(True))
        cause = F.when(F.col("customer").isNull(), "no customer").when(F.col("_known").isNull(), "unknown customer")
        return lambda rows: rows.join(known, "customer", "left").withColumn("cause", cause)

    for number in (1, 2, 3):
        repairs = None
        if number == 2:
            failed = streaming.read_ledger(spark, path, fresh.schema).filter("customer = -1").select("o_orderkey", "record_id")
            repairs = failed.join(orders, "o_orderkey").withColumnRenamed("right", "customer")
        # Records come again in every round; they are tried once a round all the same.
        streaming.try_records(spark, path, fresh, attempt(number), number, repairs)
    return streaming.read_ledger(spark, path, fresh.schema).select("o_orderkey", "customer", "tries", "state", "cause")


@_query
def run_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made by numbered scripts and counted; a second run of the scripts has nothing to do."""
    root = scratch_dir(spark, "scripts")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields + TEXT_PARTITIONS.fields)
    scripts = {
        "scripted/10_drop.ddl": "DROP TABLE IF EXISTS tidemark_scripted",
        "scripted/20_create.ddl": f"CREATE TABLE tidemark_scripted ({columns}) USING json "
        f"PARTITIONED BY ({', '.join(TIME_KEYS)}) LOCATION '${{LOCATION}}'",
        "scripted/30_partitions.ddl": "MSCK REPAIR TABLE tidemark_scripted",
    }
    values = {"scripted": {"LOCATION": inputs.landed_events(spark, sf_dir)}}
    ran = [sinks.run_scripts(spark, scripts, f"{root}/log", values) for _ in range(2)]
    counted = spark.table("tidemark_scripted").groupBy("event_type").agg(F.count("*").alias("records"))
    return counted.select("*", *[F.lit(len(r)).cast("bigint").alias(f"run_{i}") for i, r in enumerate(ran, 1)])


@_query
def write_partitioned_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "parquet")
    events = ops.time_partition_columns(_events(spark, sf_dir), "ts")
    sinks.write_partitioned_parquet(events, path, ["year", "month", "day"])
    return spark.read.schema(events.schema).parquet(path)


@_query
def stream_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ops.time_partition_columns(_event_stream(spark, sf_dir), "ts")
    return _drained(spark, stream, "stream_to_parquet", ("year", "month", "day"))


def land_lines(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Land all text records once per session and data folder."""

    def write(root: str) -> None:
        lines = streaming.stream_source(
            spark,
            inputs.landed_lines(spark, sf_dir),
            inputs.TEXT_SCHEMA,
            max_bytes=streaming.BUFFER_BYTES,
            data_format="text",
        )
        streaming.land_stream(
            lines,
            LINE_SCHEMA,
            f"{root}/curated",
            f"{root}/raw",
            f"{root}/failed",
            f"{root}/checkpoint",
            available_now=True,
        ).awaitTermination()

    root = inputs.landed_copy(spark, sf_dir, "land_stream", write)
    return {part: f"{root}/{part}" for part in ("curated", "raw", "failed")}


@_query
def stream_raw_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(land_lines(spark, sf_dir)["raw"]).select("value")


@_query
def route_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = streaming.route_malformed(inputs.event_lines(_events(spark, sf_dir)), LINE_SCHEMA)
    return good.unionByName(bad.withColumnRenamed("value", "failed_text"), allowMissingColumns=True)


@_query
def land_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = land_lines(spark, sf_dir)
    good = spark.read.parquet(paths["curated"]).select(*LINE_SCHEMA.names)
    bad = spark.read.text(paths["failed"]).select(F.col("value").alias("failed_text"))
    return good.unionByName(bad, allowMissingColumns=True)


@_query
def write_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "orders_json")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    sinks.write_json_events(orders, path)
    return spark.read.schema(orders.schema).json(path)


@_query
def register_external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = inputs.landed_events(spark, sf_dir)
    schema = T.StructType(EVENT_SCHEMA.fields + TEXT_PARTITIONS.fields)
    sinks.register_external_table(spark, "tidemark_events", schema, list(TIME_KEYS), location)
    return spark.sql(
        "SELECT year, month, day, hour, event_type, count(*) AS records, max(value) AS max_value "
        "FROM tidemark_events GROUP BY year, month, day, hour, event_type"
    )


# Projections


@_query
def apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.apply_mapping(
        table(spark, sf_dir, "customer"),
        [
            ("c_custkey", "bigint", "customer_id", "bigint"),
            ("c_name", "string", "name", "string"),
            ("c_nationkey", "int", "nation", "string"),
            ("c_acctbal", "double", "balance", "decimal(18,2)"),
            ("c_mktsegment", "string", "segment_number", "int"),
        ],
    ).withColumn("balance", F.col("balance").cast("double"))


@_query
def resolve_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("event_id", F.lit(3))
    text = (
        F.when(F.col("event_type") == "error", '{"p":null}')
        .when(F.pmod("event_id", F.lit(7)) == 0, '{"p":12345678901234567891.25}')
        .when(kind == 0, F.concat(F.lit('{"p":'), F.col("value").cast("string"), F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"p":"'), F.col("event_type"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"p":'), F.col("user_id").cast("string"), F.lit("}")))
    )
    boxed = _events(spark, sf_dir).select("event_id", F.parse_json(text).alias("box"))
    resolved = ops.resolve_choice(boxed, "box", "p")
    exact = F.col("p.decimal").cast("decimal(38,4)").cast("string").alias("p_decimal")
    return resolved.select("event_id", F.col("p.bigint").alias("p_bigint"), exact, F.col("p.string").alias("p_string"))


@_query
def drop_null_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return ops.drop_null_fields(part.withColumn("p_comment", F.when(F.col("p_partkey") < 0, "none")))


@_query
def flatten_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = ops.flatten_columns(table(spark, sf_dir, "embeddings"))
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


@_query
def flatten_map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat(F.lit("is_"), F.col("o_orderstatus"))
    boxed = F.create_map(status, F.struct(F.col("o_totalprice").alias("total")), F.lit("key"), F.struct(F.col("o_custkey").cast("double").alias("total")))
    flat = ops.flatten_columns(table(spark, sf_dir, "orders").select("o_orderkey", boxed.alias("m")))
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


@_query
def flatten_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit('{"p":'), F.col("props"), F.lit(',"t":["'), F.col("event_type"), F.lit('",null,[]],"e":{}}')
    )
    kind = F.pmod("event_id", F.lit(50))
    deep = F.concat(F.repeat(F.lit("["), F.lit(30)), F.lit("1"), F.repeat(F.lit("]"), F.lit(30)))
    text = F.when(kind == 0, F.repeat(F.lit("["), F.lit(200))).when(kind == 1, deep).otherwise(text)
    return ops.flatten_paths(_events(spark, sf_dir).select("event_id", text.alias("json")), "event_id", "json")


@_query
def row_to_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ops.row_to_event(table(spark, sf_dir, "customer"))
    return events.select("status", "headers", "data", F.array_join("fields", "|").alias("fields"))


@_query
def decode_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = ops.decode_payload(inputs.payloads(table(spark, sf_dir, "embeddings")))
    return decoded.select(
        "vec_id",
        "fragment",
        "frame",
        "stream_name",
        F.size("prediction").cast("bigint").alias("n_predictions"),
        F.array_max(F.transform("prediction", lambda p: p[1])).alias("top_score"),
        F.aggregate("prediction", F.lit(0.0), lambda a, p: a + p[0]).alias("sum_class"),
        F.round(F.aggregate("prediction", F.lit(0.0), lambda a, p: a + p[1]), 6).alias("sum_score"),
    )


@_query
def unreadable_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unreadable = plans.detections_report(inputs.payloads(table(spark, sf_dir, "embeddings")))
    return unreadable


@_query
def partition_values_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = partition_path(time_parts(F.col("ts")), "sensors")
    path = F.concat(folder, F.lit("/part-"), F.col("event_id").cast("string"), F.lit(".json"))
    listed = _events(spark, sf_dir).select("event_id", path.alias("path"))
    found = ops.partition_values_from_path(listed, "path", values_col="parts")
    return found.withColumn("parts", F.array_join("parts", "/")).drop("path")


@_query
def time_partition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.time_partition_columns(_events(spark, sf_dir).select("event_id", "ts"), "ts")


@_query
def normalise_partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpadded = {k: F.date_format("ts", f) for k, f in zip(TIME_KEYS, ("y", "M", "d", "H"), strict=True)}
    # Some numbers are wider than their key.
    wide = F.when(F.pmod("event_id", F.lit(13)) == 0, "1").otherwise("")
    events = _events(spark, sf_dir).select("event_id", *[F.concat(c, wide).alias(k) for k, c in unpadded.items()])
    padded = ops.normalise_partition_keys(events, "padded")
    both = padded.select("event_id", *TIME_KEYS, *[F.col(k).alias(f"{k}_text") for k in TIME_KEYS])
    return _wide(ops.normalise_partition_keys(both, "int"), *TIME_KEYS)


# Filters


@_query
def require_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, rejected = ops.read_notices(inputs.notices(table(spark, sf_dir, "documents")))
    kept = kept.withColumns({"outcome": F.lit("kept"), "body": F.lit(None).cast("string")})
    return kept.unionByName(rejected.withColumn("outcome", F.lit("rejected")))


@_query
def split_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, _ = sources.scan_change_images(inputs.change_records(table(spark, sf_dir, "orders")))
    images = ops.split_images(read)
    return images.select("o_orderkey", "kind", F.col("image")["status"]["S"].alias("status"))


@_query
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ops.explode_predictions(inputs.predictions(table(spark, sf_dir, "embeddings")))
    return ops.score_threshold(scores)


@_query
def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = sources.projected_glob({"year": None, "month": None, "day": ["05"]})
    return _raw_events(spark, sf_dir, folders=folders)


@_query
def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.when(F.pmod("o_orderkey", F.lit(20)) != 0, F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", customer.alias("customer_id"), "o_totalprice")
    return ops.clean_orders(orders)


# Unnest and generate


@_query
def distinct_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue that gets each notice wrapped and, a second later, bare: one row per object."""
    path = scratch_dir(spark, "doubled")
    wrapped = inputs.notices(table(spark, sf_dir, "documents")).withColumn("ts", F.timestamp_seconds("doc_id"))
    bare = wrapped.withColumns(
        {"body": F.get_json_object("body", "$.Message"), "ts": F.timestamp_seconds(F.col("doc_id") + 1)}
    )
    both = wrapped.unionByName(bare.filter("body IS NOT NULL"))
    both.write.parquet(path)
    stream = streaming.stream_source(spark, path, both.schema, data_format="parquet")
    found = ops.distinct_notices(stream, "ts", "1 hour").filter("key <> ''").select("doc_id", "key", "bucket", "arn")
    return _drained(spark, found, "distinct_notices")


@_query
def unnest_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unnest_notifications(inputs.notices(table(spark, sf_dir, "documents")))


@_query
def explode_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.explode_predictions(inputs.predictions(table(spark, sf_dir, "embeddings")))


@_query
def partition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = (
        _events(spark, sf_dir)
        .groupBy("event_type")
        .agg(F.min(F.year("ts")).alias("first_year"), F.max(F.year("ts")).alias("last_year"))
    )
    ranges = {**ops.SENSOR_RANGES, "year": (F.col("first_year"), F.col("last_year"))}
    grid = ops.partition_grid(years, ranges, root="sensors").drop("first_year", "last_year")
    return _wide(grid, *TIME_KEYS)


@_query
def synthetic_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    drawn = ops.order_fields(orders, "o_orderkey", F.col("o_orderdate"), 1, uniform=inputs.sha_uniform)
    return drawn.withColumn("price", F.round("price", 4)).drop("o_orderdate")


@_query
def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "orders").schema
    rows = streaming.stream_source(spark, sf_dir, schema, data_format="parquet", glob="orders.parquet")
    ticks = rows.select("o_orderkey", "o_orderdate")
    drawn = ops.order_fields(ticks, "o_orderkey", F.col("o_orderdate"), 2, uniform=inputs.sha_uniform)
    return _drained(spark, drawn.withColumn("price", F.round("price", 4)).drop("o_orderdate"), "order_stream")


# Joins


@_query
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") * 9 - 1).alias("class"))
    return ops.label_lookup(numbered)


@_query
def partition_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = ops.distinct_time_partitions(_events(spark, sf_dir), "ts", ["event_type"])
    actual = ops.normalise_partition_keys(present, "int")
    expected = ops.expected_hours(_events(spark, sf_dir), "ts", ["event_type"])
    return _wide(ops.partition_gaps(expected, actual, ["event_type", *TIME_KEYS]), *TIME_KEYS)


@_query
def stale_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    changes = table(spark, sf_dir, "orders").select(month, "o_orderdate")
    number = F.substring("month", 6, 2).cast("int")
    shift = F.when(number % 3 == 1, F.expr("INTERVAL -1 DAY")).otherwise(F.expr("INTERVAL 1 DAY"))
    loads = changes.filter(number % 3 != 0).select("month", (F.col("o_orderdate") + shift).alias("loaded_at"))
    return ops.stale_partitions(changes, loads, ["month"], "o_orderdate", "loaded_at")


@_query
def revenue_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    people = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    revenue = ops.revenue_by_state(orders, people, "o_custkey", "price", "c_custkey", "n_name")
    return revenue.withColumn("revenue", F.col("revenue").cast("double"))


# Aggregations


@_query
def best_score_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ops.explode_predictions(inputs.predictions(table(spark, sf_dir, "embeddings")))
    return ops.best_score_per_class(scores, ["vec_id"])


@_query
def best_scores_in_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_scores_in_record(inputs.predictions(table(spark, sf_dir, "embeddings")))


@_query
def distinct_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = sources.object_listing(spark, inputs.landed_events(spark, sf_dir))
    return ops.distinct_partitions(ops.partition_values_from_path(listed, "path"))


@_query
def batch_record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_format("ts", "yyyy-MM-dd HH").alias("batch")
    return ops.batch_record_count(_events(spark, sf_dir).select(hour), ["batch"])


@_query
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "documents_text")
    # One line per document: its text without line breaks.
    line = F.translate("text", "\r\n", "  ").alias("value")
    table(spark, sf_dir, "documents").select(line).repartition(4).write.text(path)
    profile = ops.table_profile(spark, path)
    return profile.select("objects", "records", "total_bytes", "record_bytes", F.round("average_record_size", 6).alias("average"))


@_query
def per_minute_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = ops.per_minute_sums(_events(spark, sf_dir), "ts", ["event_type"], "props")
    return sums.withColumn("minute", _ntz("minute"))


@_query
def per_minute_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.make_dt_interval(secs=(F.pmod(F.col("event_id") * 37, F.lit(5000)) / 1000).cast("decimal(18,6)"))
    events = _events(spark, sf_dir).select("event_type", "ts", (F.col("ts") + delay).alias("arrived"))
    lag = ops.per_minute_lag(events, "ts", "arrived", ["event_type"])
    return lag.select(_ntz("minute"), "event_type", "max_lag_ms", F.round("avg_lag_ms", 6).alias("avg_lag_ms"))


@_query
def top_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_sku(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


@_query
def stream_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts sold most, from a stream: a bounded summary, then exact counts of what it cannot rule out."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey")
    rows = streaming.stream_source(spark, sf_dir, sold.schema, data_format="parquet", glob="lineitem.parquet")
    root = scratch_dir(spark, "stream_top")
    streaming.stream_top(rows, "l_partkey", f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    summary = streaming.read_summary(spark, f"{root}/out", sold.schema["l_partkey"].dataType)
    return streaming.exact_top(summary, sold, "l_partkey", 10)


# Windows


@_query
def m_of_n_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarm = ops.m_of_n_alarm(_events(spark, sf_dir), "ts", "value", ["event_type"])
    average = F.round("average", 6).alias("average")
    return _wide(alarm.select(_ntz("period"), "event_type", average, "breaches", "alarm"), "breaches")


@_query
def stream_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alarm on a stream of the events, for the periods that the watermark closes."""
    schema = _events(spark, sf_dir).schema
    rows = streaming.stream_source(spark, sf_dir, schema, data_format="parquet", glob="events.parquet")
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    root, keys = scratch_dir(spark, "stream_alarm"), ["event_type"]
    streaming.stream_alarm(
        rows, "ts", "value", f"{root}/out", f"{root}/checkpoint", "10 minutes", keys, available_now=True
    ).awaitTermination()
    alarm = streaming.read_alarms(spark, f"{root}/out", rows, "ts", "value", keys)
    return alarm.select(_ntz("period"), "event_type", F.round("average", 6).alias("average"), "breaches", "alarm")


# Whole jobs


@_query
def curated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON to curated Parquet, read back as rows by type and day."""
    target = scratch_dir(spark, "curated")
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("note", T.StringType())])
    mapping = [
        ("event_id", "bigint", "event_id", "bigint"),
        ("ts", "string", "datetime", "string"),
        ("event_type", "string", "event_type", "string"),
        ("value", "double", "value", "double"),
        ("note", "string", "note", "string"),
        *[(k, "string", k, "int") for k in TIME_KEYS],
    ]
    plans.curate(spark, inputs.landed_events(spark, sf_dir), target, schema, TEXT_PARTITIONS, mapping)
    curated = spark.read.parquet(target)
    return _wide(curated, "day").groupBy("event_type", "day").agg(
        F.count("*").alias("records"),
        F.min("datetime").alias("first_datetime"),
        F.max("value").alias("max_value"),
        F.lit("note" in curated.columns).alias("has_note"),
    )


@_query
def refreshed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables to refresh, chosen from event times, then registered and counted."""
    root = inputs.landed_types(spark, sf_dir)
    fields = [f for f in EVENT_SCHEMA.fields if f.name != "event_type"]
    schema = T.StructType(fields + TEXT_PARTITIONS.fields)
    names = ("click", "error", "view")
    definitions = {name: (schema, list(TIME_KEYS), f"{root}/event_type={name}") for name in names}
    changes = _events(spark, sf_dir).select(F.col("event_type").alias("name"), "ts")
    late = F.expr("INTERVAL 1 DAY")
    loads = changes.filter(F.col("name") != "click").select(
        "name", F.when(F.col("name") == "view", F.col("ts") + late).otherwise(F.col("ts") - late).alias("loaded_at")
    )
    renamed = {f"tidemark_{n}": d for n, d in definitions.items()}
    prefixed = [d.withColumn("name", F.concat(F.lit("tidemark_"), "name")) for d in (changes, loads)]
    names = plans.refresh_tables(spark, *prefixed, "name", "ts", "loaded_at", renamed)
    counts = [spark.table(n).select(F.lit(n).alias("name")) for n in names]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("name").agg(F.count("*").alias("records"))


@_query
def ingested_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices for the upload files of all but one segment and for one that is not there; rows and rejects."""
    root = inputs.landed_uploads(spark, sf_dir)
    key = F.regexp_extract("path", "/uploads/(.*)$", 1)
    listed = sources.object_listing(spark, root).filter(~F.col("path").contains("segment=machinery"))
    record = F.struct(
        F.struct(
            F.struct(key.alias("key")).alias("object"),
            F.struct(F.lit("uploads").alias("name"), F.lit("arn:uploads").alias("arn")).alias("bucket"),
        ).alias("s3")
    )
    message = F.to_json(F.struct(F.array(record, record).alias("Records")))
    paths = listed.select("path").unionByName(listed.select(F.lit("/uploads/absent.csv").alias("path")).distinct())
    bodies = paths.select(F.to_json(F.struct(message.alias("Message"))).alias("body"))
    events, rejected = plans.ingest_uploads(spark, bodies, root)
    missing = rejected.select(F.lit("rejected").alias("status"), F.col("key").alias("headers"), F.lit(None).alias("data"))
    return events.select("status", "headers", "data").union(missing)


@_query
def detections_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = plans.detections_report(inputs.payloads(table(spark, sf_dir, "embeddings")))
    return report.select("vec_id", "stream_name", "class", "class_name", "score")
