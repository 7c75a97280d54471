from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import operators as ops
from tidemark import plans, sinks, sources
from tidemark.functions import path_values

SENSOR_SCHEMA = T.StructType(
    [
        T.StructField("datetime", T.StringType()),
        T.StructField("sensorid", T.IntegerType()),
        T.StructField("temp", T.IntegerType()),
        T.StructField("battery", T.StringType()),
    ]
)


def partition_schema(dtype):
    return T.StructType([T.StructField(k, dtype) for k in ("year", "month", "day", "hour")])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def sensors(spark, tmp_path):
    """Two hours of sensor readings, padded folders, one column of nulls."""
    for hour, n in (("17", 3), ("20", 2)):
        folder = tmp_path / f"year=2017/month=08/day=14/hour={hour}"
        folder.mkdir(parents=True)
        lines = [
            f'{{"datetime":"2017-08-14 13:00:0{i}","sensorid":{i},"temp":{10 * i},"battery":null,"extra":1}}'
            for i in range(n)
        ]
        (folder / "readings.json").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_declared_partitions_keep_padding_and_prune(spark, sensors):
    df = sources.scan_partitioned_json(spark, sensors, SENSOR_SCHEMA, partition_schema(T.StringType()))
    assert rows(df.select("month", "hour").distinct()) == [("08", "17"), ("08", "20")]
    one = df.filter(F.col("hour") == "20")
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan
    assert "PushedFilters: []" in plan


def test_projected_folders_list_only_what_is_asked(spark, sensors):
    glob = sources.projected_glob({"year": ["2017"], "month": ["08"], "day": None, "hour": ["20", "21"]})
    assert glob == "year=2017/month=08/day=*/hour={20,21}"
    df = sources.scan_partitioned_json(spark, sensors, SENSOR_SCHEMA, partition_schema(T.StringType()), glob)
    assert rows(df.select("year", "month", "day", "hour").distinct()) == [("2017", "08", "14", "20")]
    assert len(df.inputFiles()) == 1


def test_corrupt_column(spark, tmp_path):
    folder = tmp_path / "year=2017/month=8/day=1/hour=1"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text('{"temp":1}\n{"temp":"oops"}\nno json\n')
    df = sources.scan_partitioned_json(
        spark, str(tmp_path), SENSOR_SCHEMA, partition_schema(T.IntegerType()), corrupt_column="_bad"
    )
    assert rows(df.select("temp", "_bad", "month")) == [
        (1, None, 8),
        (None, "no json", 8),
        (None, '{"temp":"oops"}', 8),
    ]


def test_external_table(spark, sensors):
    schema = T.StructType(SENSOR_SCHEMA.fields + partition_schema(T.StringType()).fields)
    for _ in range(2):
        table = sinks.register_external_table(spark, "sensors_test", schema, ["year", "month", "day", "hour"], sensors)
    assert table.count() == 5
    assert spark.sql("SELECT count(*) FROM sensors_test WHERE month = '08' AND hour = '17'").first()[0] == 3
    assert spark.sql("SHOW PARTITIONS sensors_test").count() == 2


def test_listing_profile_and_distinct_partitions(spark, sensors):
    (out,) = ops.table_profile(spark, sensors).collect()
    listed = sources.object_listing(spark, sensors)
    assert (out.objects, out.records) == (2, 5)
    assert out.total_bytes == listed.agg(F.sum("length")).first()[0]
    assert out.record_bytes == out.total_bytes - 5
    parts = ops.distinct_partitions(ops.partition_values_from_path(listed, "path"))
    assert rows(parts) == [("2017", "08", "14", "17"), ("2017", "08", "14", "20")]


def test_path_values(spark):
    df = spark.createDataFrame([("sensors/year=2017/month=08/day=14/hour=17/file",), ("plain/file",)], "p string")
    assert [r[0] for r in df.select(path_values(F.col("p"))).collect()] == [["2017", "08", "14", "17"], []]
    found = ops.partition_values_from_path(df, "p").select("year", "hour")
    assert [tuple(r) for r in found.collect()] == [("2017", "17"), (None, None)]


def test_normalised_keys_meet(spark):
    padded = spark.createDataFrame([("2017", "08", "04", "07")], "year string, month string, day string, hour string")
    plain = spark.createDataFrame([(2017, 8, 4, 7)], "year int, month int, day int, hour int")
    for style in ("padded", "int"):
        a, b = (ops.normalise_partition_keys(df, style) for df in (padded, plain))
        assert rows(a) == rows(b)
    with pytest.raises(ValueError):
        ops.normalise_partition_keys(padded, "roman")


def test_grid(spark):
    grid = ops.partition_grid(spark, template={"month": 2, "day": 2, "hour": 2}, root="data/sensors")
    assert grid.count() == 35_712
    location = "data/sensors/year=2017/month=02/day=31/hour=05"
    assert grid.filter(F.col("location") == location).count() == 1
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()


def test_gaps(spark):
    expected = spark.range(5).selectExpr("id AS hour")
    actual = spark.sql("SELECT IF(id < 900, 2, 4) AS hour FROM range(1000)")
    assert rows(ops.partition_gaps(expected, actual, ["hour"])) == [(0,), (1,), (3,)]


def test_time_partitions_present(spark):
    df = spark.sql("SELECT timestamp'2024-02-29 23:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts FROM range(180)")
    present = ops.distinct_time_partitions(df, "ts")
    assert rows(present) == [("2024", "02", "29", "23"), ("2024", "03", "01", "00"), ("2024", "03", "01", "01")]
    days = ops.distinct_time_partitions(df, "ts", keys=["year", "month", "day"])
    assert rows(days) == [("2024", "02", "29"), ("2024", "03", "01")]


def test_stale(spark):
    t = datetime(2020, 1, 1)
    sources_ = spark.createDataFrame(
        [("never", t), ("old", t), ("old", t + timedelta(days=2)), ("fresh", t), ("equal", t)], "k string, at timestamp"
    )
    loads = spark.createDataFrame(
        [("old", t + timedelta(days=1)), ("fresh", t), ("fresh", t + timedelta(days=1)), ("equal", t)],
        "k string, loaded timestamp",
    )
    stale = ops.stale_partitions(sources_, loads, ["k"], "at", "loaded")
    assert [r[0] for r in rows(stale)] == ["never", "old"]


def test_refresh_registers_only_what_is_stale(spark, sensors):
    schema = T.StructType(SENSOR_SCHEMA.fields + partition_schema(T.StringType()).fields)
    definition = (schema, ["year", "month", "day", "hour"], sensors)
    t = datetime(2020, 1, 1)
    changes = spark.createDataFrame([("t_new", t), ("t_done", t), ("t_unknown", t)], "name string, at timestamp")
    loads = spark.createDataFrame([("t_done", t + timedelta(hours=1))], "name string, loaded timestamp")
    names = plans.refresh_tables(
        spark, changes, loads, "name", "at", "loaded", {"t_new": definition, "t_done": definition}
    )
    assert names == ["t_new"] and spark.table("t_new").count() == 5


@pytest.mark.parametrize("compact", [None, True, False])
def test_curate(spark, sensors, tmp_path_factory, compact):
    target = str(tmp_path_factory.mktemp("curated"))
    plans.curate(
        spark, sensors, target, SENSOR_SCHEMA, partition_schema(T.StringType()), plans.SENSOR_MAPPING, compact=compact
    )
    out = spark.read.parquet(target)
    assert sorted(out.columns) == ["datetime", "day", "hour", "month", "sensorid", "temp", "year"]
    assert out.agg(F.count("*"), F.sum("temp"), F.min("hour"), F.max("month")).first()[:] == (5, 40, 17, 8)
    assert list(Path(target).glob("year=2017/month=8/day=14/*.parquet"))


def test_curate_resolves_mixed_types(spark, tmp_path, tmp_path_factory):
    folder = tmp_path / "year=2020/month=1/day=1/hour=1"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text('{"id":1,"p":1}\n{"id":2,"p":"x"}\n{"id":3}\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("p", T.VariantType())])
    mapping = [("id", "int", "id", "int"), ("p", "variant", "p", "variant")]
    mapping += [(k, "int", k, "int") for k in ("year", "month", "day")]
    target = str(tmp_path_factory.mktemp("curated"))
    plans.curate(spark, str(tmp_path), target, schema, partition_schema(T.IntegerType()), mapping, choices=["p"])
    out = spark.read.parquet(target).select("id", "p.bigint", "p.string")
    assert rows(out) == [(1, 1, None), (2, None, "x"), (3, None, None)]


def test_hot_folder_is_split_over_several_files(spark, tmp_path):
    """A third of all rows in one folder: adaptive execution spreads its write."""
    df = spark.range(0, 400_000, 1, 16).selectExpr(
        "id", "xxhash64(id) AS noise", "CAST(IF(id % 3 = 0, 0, id % 40) AS int) AS day"
    )
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sinks.write_partitioned_parquet(df, str(tmp_path / "hot"), ["day"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "hot").glob("day=*")}
    assert files["day=0"] > 3 and sorted(files.values())[0] == 1
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 400_000


def test_write_json_keeps_nulls(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, CAST(NULL AS string) AS customer_id, 'a' AS k")
    sinks.write_json_events(df, str(tmp_path / "out"), ["k"])
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"id":1,"customer_id":null}'


def alarm_points(spark):
    start = datetime(2024, 1, 1)
    averages = [10, 70, 20, 61, 60, 5, 5]
    data = [(start + timedelta(minutes=5 * i, seconds=s), float(a + d), "svc") for i, a in enumerate(averages) for s, d in ((0, -1), (60, 1))]
    return spark.createDataFrame(data, "ts timestamp, cpu double, service string")


def test_alarm(spark):
    out = ops.m_of_n_alarm(alarm_points(spark), "ts", "cpu", ["service"]).orderBy("period").collect()
    assert [r.average for r in out] == [10, 70, 20, 61, 60, 5, 5]
    assert [r.breaches for r in out] == [0, 1, 1, 2, 2, 2, 1]
    assert [r.alarm for r in out] == [False, False, False, True, True, True, False]


def test_alarm_without_keys(spark):
    out = ops.m_of_n_alarm(alarm_points(spark), "ts", "cpu").orderBy("period").collect()
    assert [r.breaches for r in out] == [0, 1, 1, 2, 2, 2, 1]


def test_lag(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(t, t + timedelta(milliseconds=100)), (t, t + timedelta(milliseconds=300)), (t, t + timedelta(seconds=61))],
        "sent timestamp, got timestamp",
    )
    out = ops.per_minute_lag(df, "sent", "got").orderBy("minute").collect()
    assert [(r.max_lag_ms, r.avg_lag_ms) for r in out] == [(300, 200.0), (61000, 61000.0)]


def test_wide_keys_stay_whole(spark):
    df = spark.createDataFrame([("20201", "123", "8", "100")], "year string, month string, day string, hour string")
    assert tuple(ops.normalise_partition_keys(df).first()) == ("20201", "123", "08", "100")
    grid = ops.partition_grid(spark, {"month": (99, 101)}, {"month": 2})
    assert [r.location for r in grid.collect()] == ["month=99", "month=100", "month=101"]


def test_expected_hours_follow_the_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP'2023-02-28 22:59:00' AS ts UNION ALL SELECT TIMESTAMP'2023-03-01 01:00:00'")
    hours = [tuple(r) for r in ops.expected_hours(df, "ts").collect()]
    assert sorted(hours) == [(2023, 2, 28, 22), (2023, 2, 28, 23), (2023, 3, 1, 0), (2023, 3, 1, 1)]


def test_periods_without_an_average_are_left_out(spark):
    averages = spark.createDataFrame([(i, a) for i, a in enumerate([70.0, None, 70.0])], "period int, average double")
    found = [tuple(r) for r in ops.alarm_states(averages, m=2, n=2).orderBy("period").collect()]
    assert found == [(0, 70.0, 1, False), (2, 70.0, 2, True)]


def test_registration_adds_new_partitions_only(spark, tmp_path):
    location = f"{tmp_path}/it's"
    schema = T.StructType().add("s", T.StructType().add("b c", T.IntegerType())).add("day", "string")

    def put(day, value):
        spark.range(1).selectExpr(f"named_struct('b c', {value}) AS s").write.json(f"{location}/day={day}")

    try:
        put("01", 1)
        table = sinks.register_external_table(spark, "added_test", schema, ["day"], location)
        assert [r.s[0] for r in table.collect()] == [1]
        put("02", 2)
        assert sorted(r.s[0] for r in sinks.register_external_table(spark, "added_test", schema, ["day"], location).collect()) == [1, 2]
        days = sinks.table_partitions(spark, "added_test", ["day"])
        assert sorted(r.day for r in days.collect()) == ["01", "02"]
        assert sinks.add_partitions(spark, "added_test", days, ["day"]) == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS added_test")
