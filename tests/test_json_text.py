"""What counts as exactly one JSON value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import operators as ops
from tidemark import sources, streaming
from tidemark.functions import ends_there, is_one_value, may_go_on, one_object, one_variant

ONE = ['{"a":1}', ' {"a":1,"b":{"a":2}}\n', "[1,[2]]", "5", '"x"', "null", '{"a":1,"a":2}', '{"a":"]}"}', "{}", "[]", '"] , ["']
NOT_ONE = [
    "", " ", None, '{"a":1} tail', '{"a":1}{"a":1}', '{"a":1', '{"a":1}]', "1]", "[1", "1],[2", '{"a":1}],"v":[{"a":2}', "1,2",
    "{'a':1}", "tail", '{"a":1},', ',{"a":1}', '{"a":1},{"a":2}', "NaN",
]


def test_one_value(spark):
    df = spark.createDataFrame([(t,) for t in ONE + NOT_ONE], "t string")
    got = {r.t: r.one for r in df.select("t", is_one_value(F.col("t")).alias("one")).collect()}
    assert got == {**dict.fromkeys(ONE, True), **dict.fromkeys(NOT_ONE, False)}


def test_ends_there(spark):
    """Texts that a parser takes by their first value; single quotes are for the parser to reject."""
    df = spark.createDataFrame([(t,) for t in ONE + NOT_ONE], "t string")
    got = {r.t for r in df.where(ends_there(F.col("t"))).collect()}
    assert got - {"{'a':1}", "NaN"} == set(ONE)


def test_one_variant(spark):
    df = spark.createDataFrame([(t,) for t in ONE + NOT_ONE], "t string")
    got = df.select("t", F.to_json(one_variant(F.col("t"))).alias("v")).where("v IS NOT NULL")
    assert {r.t for r in got.collect()} == set(ONE)


def test_one_object(spark):
    df = spark.createDataFrame([(t,) for t in ONE + NOT_ONE], "t string")
    got = {r.t: r.v.a for r in df.select("t", one_object(F.col("t"), "struct<a: int>").alias("v")).collect() if r.v}
    assert got == {'{"a":1}': 1, ' {"a":1,"b":{"a":2}}\n': 1, '{"a":1,"a":2}': 2, '{"a":"]}"}': None, "{}": None}


def test_only_doubtful_ends_are_looked_at(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1} ',), ('{"a":{}}',), ('{"a":1}x',), ('{"a":1}{"a":1}',)], "t string")
    assert [r[0] for r in df.select(may_go_on(F.col("t"))).collect()] == [False, False, True, True, True]


def test_repeated_keys_are_no_reject(spark):
    twice = '{"a":1,"b":"x","a":2}'
    lines = spark.createDataFrame([(twice,), (twice + twice,), ('{"a":"x","a":2}',)], "value string")
    good, bad = streaming.route_malformed(lines, streaming_schema())
    assert (2, "x") in [tuple(r) for r in good.collect()] and twice + twice in [r.value for r in bad.collect()]
    body = '{"Records":[],"Records":[{"dynamodb":{"NewImage":{"k":{"N":"1"},"k":{"N":"2"}}}}]}'
    images, unreadable = sources.scan_change_images(spark.createDataFrame([(body,)], "body string"))
    assert unreadable.isEmpty() and images.count() == 1
    notice = '{"Message":"x","Message":"{\\"Records\\":[{\\"s3\\":{\\"object\\":{\\"key\\":\\"a\\",\\"key\\":\\"b\\"}}}]}"}'
    found = ops.unnest_notifications(spark.createDataFrame([(notice,)], "body string"))
    assert [r.key for r in found.collect()] == ["b"]
    paths = ops.flatten_paths(spark.createDataFrame([(1, twice)], "id int, j string"), "id", "j")
    assert sorted((r.path, r.value) for r in paths.collect()) == [("a", "2"), ("b", "x")]


def streaming_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
