from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import operators as ops

NESTED = '{"a":[1,{"b":null}],"c":{"d":[],"e":"z"}}'


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_flatten_paths_edges(spark):
    df = spark.createDataFrame(
        [
            (1, NESTED),
            (2, '{"a.0":9,"a":[1]}'),
            (3, '{"s":"[]","t":"{}","u":{},"v":true,"w":"a\\"{[b"}'),
            (4, "not json"),
            (5, None),
            (6, "[]"),
        ],
        "id int, j string",
    )
    assert rows(ops.flatten_paths(df, "id", "j")) == sorted(
        [
            (1, "a.0", "1"),
            (1, "a.1.b", None),
            (1, "c.e", "z"),
            (2, "a.0", "1"),
            (2, "a.0", "9"),
            (3, "s", "[]"),
            (3, "t", "{}"),
            (3, "v", "true"),
            (3, "w", 'a"{[b'),
            (4, None, "not json"),
        ],
        key=repr,
    )


def test_flatten_paths_id_may_be_named_like_a_generated_column(spark):
    df = spark.createDataFrame([(7, '{"k":[1]}')], "key int, value string")
    assert rows(ops.flatten_paths(df, "key", "value")) == [(7, "k.0", "1")]


def test_flatten_paths_keeps_what_lies_below_a_given_depth(spark):
    df = spark.createDataFrame([(1, NESTED)], "id int, j string")
    assert rows(ops.flatten_paths(df, "id", "j", max_depth=1)) == [
        (1, "a", '[1,{"b":null}]'),
        (1, "c", '{"d":[],"e":"z"}'),
    ]


def test_flatten_paths_of_malformed_and_deep_texts(spark):
    deep = "[" * 200 + "7" + "]" * 200
    texts = {
        1: "[" * 200, 2: deep, 3: "[" * 10_000 + "]" * 10_000, 4: '{"a":1}{"a":2}', 5: '{"a":1} junk', 6: '{"a":1},{"a":2}',
        7: "5", 8: "", 9: '[[],{},null,[null]]',
    }
    df = spark.createDataFrame(list(texts.items()), "id int, j string")
    kept = [(i, None, texts[i]) for i in (1, 3, 4, 5, 6, 8)]
    expected = [*kept, (2, ".".join(["0"] * 200), "7"), (7, "", "5"), (9, "2", None), (9, "3.0", None)]
    assert rows(ops.flatten_paths(df, "id", "j")) == sorted(expected, key=repr)


def test_flatten_paths_deep(spark):
    text = "[" * 12 + "7" + "]" * 12
    df = spark.createDataFrame([(1, f'{{"k":{text}}}')], "id int, j string")
    assert rows(ops.flatten_paths(df, "id", "j")) == [(1, "k" + ".0" * 12, "7")]


def test_flatten_paths_plan_reads_once_without_shuffle(spark):
    df = spark.range(3).select("id", F.concat(F.lit('{"a":[{"b":'), F.col("id").cast("string"), F.lit("}]}")).alias("j"))
    plan = ops.flatten_paths(df, "id", "j", max_depth=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan
    # Once to check that it is a single value, once for the value.
    assert plan.count("Range") == 1 and plan.lower().count("parsejson") <= 3


def test_flatten_columns(spark):
    df = spark.sql(
        "SELECT 1 AS id, named_struct('l', array(1, 2), 'm', named_struct('x', 'y')) AS k "
        "UNION ALL SELECT 2, named_struct('l', array(3), 'm', CAST(NULL AS struct<x: string>))"
    )
    flat = ops.flatten_columns(df)
    assert flat.columns == ["id", "k.l.0", "k.l.1", "k.m.x"]
    assert rows(flat) == [(1, 1, 2, "y"), (2, 3, None, None)]


def test_flatten_columns_array_of_arrays_and_structs(spark):
    df = spark.sql("SELECT array(array(1, 2, 3), array(4)) AS p, array(named_struct('a', array('u'))) AS q")
    flat = ops.flatten_columns(df)
    assert flat.columns == ["p.0.0", "p.0.1", "p.0.2", "p.1.0", "p.1.1", "p.1.2", "q.0.a.0"]
    assert rows(flat) == [(1, 2, 3, 4, None, None, "u")]


def test_flatten_columns_checks_declared_sizes(spark):
    df = spark.sql("SELECT array(1, 2, 3) AS a")
    assert rows(ops.flatten_columns(df, {"a": 3})) == [(1, 2, 3)]
    with pytest.raises(Exception, match="longer than the 2 elements"):
        ops.flatten_columns(df, {"a": 2}).select("`a.0`").collect()
    with pytest.raises(ValueError, match="no size given"):
        ops.flatten_columns(df, {})


def test_flatten_columns_name_clash(spark):
    with pytest.raises(ValueError, match="flatten to the name a.0"):
        ops.flatten_columns(spark.sql("SELECT 9 AS `a.0`, array(1) AS a"))


def test_resolve_choice_keeps_types_apart(spark):
    df = spark.createDataFrame([(1, '{"p":1}'), (2, '{"p":"x"}'), (3, '{"p":null}'), (4, '{"q":1}')], "id int, j string")
    boxed = df.select("id", F.parse_json("j").alias("v"))
    out = ops.resolve_choice(boxed, "v", "p").select("id", "p.bigint", "p.string")
    assert rows(out) == [(1, 1, None), (2, None, "x"), (3, None, None), (4, None, None)]


def test_resolve_choice_without_conflict_is_a_plain_column(spark):
    boxed = spark.sql("SELECT parse_json('{\"p\":1}') AS v")
    assert ops.resolve_choice(boxed, "v", "p").schema["p"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        ops.resolve_choice(boxed, "v", "p", action="drop")


def test_drop_null_fields(spark):
    df = spark.sql("SELECT id, CAST(NULL AS int) AS gone, IF(id = 900, 'x', NULL) AS rare FROM range(1000)")
    assert ops.drop_null_fields(df).columns == ["id", "rare"]
    assert ops.drop_null_fields(df.filter("id < 0")).columns == ["id", "gone", "rare"]


def test_apply_mapping(spark):
    df = spark.sql("SELECT '7' AS a, 'x' AS b, named_struct('c', 5) AS s, 1 AS unused")
    out = ops.apply_mapping(
        df, [("a", "string", "n", "int"), ("b", "string", "m", "int"), ("s.c", "int", "c", "string")]
    )
    assert out.columns == ["n", "m", "c"] and rows(out) == [(7, None, "5")]


def test_resolve_choice_keeps_every_kind_and_digit(spark):
    values = [
        "12345678901234567891", "1.25", "true", "null", '"t"', "7", '{"a":1}', "[2]",
    ]
    boxed = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, j string")
    boxed = boxed.select("id", F.parse_json("j").alias("v"))
    out = {r.id: r.v.asDict() for r in ops.resolve_choice(boxed, "v").collect()}
    assert str(out[0]["decimal"]) == "12345678901234567891.00" and str(out[1]["decimal"]) == "1.25"
    assert out[2]["boolean"] is True and out[4]["string"] == "t" and out[5]["bigint"] == 7
    assert out[6]["object"] == '{"a":1}' and out[7]["array"] == "[2]"
    assert not any(v is not None for v in out[3].values())


def test_resolve_choice_of_dates_and_floats(spark):
    typed = "CASE id WHEN 0 THEN CAST(DATE'2024-02-29' AS VARIANT) WHEN 1 THEN CAST(CAST(1.5 AS FLOAT) AS VARIANT) END AS v"
    out = ops.resolve_choice(spark.range(3).selectExpr("id", typed), "v").orderBy("id").collect()
    assert str(out[0].v.date) == "2024-02-29" and out[1].v.float == 1.5


def test_resolve_choice_raises_on_a_kind_that_is_not_declared(spark):
    boxed = spark.createDataFrame([("1",), ('"x"',)], "j string").select(F.parse_json("j").alias("v"))
    with pytest.raises(Exception, match="unexpected kind"):
        ops.resolve_choice(boxed, "v", kinds=["BIGINT", "DOUBLE"]).collect()
    with pytest.raises(ValueError, match="no struct member"):
        ops.resolve_choice(boxed, "v", kinds=["UUID"])


def test_flatten_columns_of_maps(spark):
    df = spark.createDataFrame([(1, {"a": [1, 2], "b": [3]}), (2, {"c": []}), (3, None)], "id int, m map<string,array<int>>")
    flat = ops.flatten_columns(df, {"m.a": 2, "m.b": 2, "m.c": 2}, {"m": ["a", "b", "c"]})
    assert flat.columns == ["id", "m.a.0", "m.a.1", "m.b.0", "m.b.1", "m.c.0", "m.c.1"]
    simple = spark.createDataFrame([({"a": 1},), ({"b.c": 2},)], "m map<string,int>")
    assert ops.flatten_columns(simple).columns == ["m.a", "m.b.c"]
    with pytest.raises(Exception, match="not declared"):
        ops.flatten_columns(simple, map_keys={"m": ["a"]}).collect()
    with pytest.raises(ValueError, match="more than 1 keys"):
        ops.flatten_columns(simple, max_columns=1)
