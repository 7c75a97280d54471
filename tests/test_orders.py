from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark import operators as ops
from tidemark.operators.orders import CATEGORIES, CUSTOMER_WEIGHTS

N = 60_000


@pytest.fixture(scope="module")
def orders(spark):
    df = ops.synthetic_orders(spark, N, seed=3).persist()
    yield df
    df.unpersist()


def test_shape(orders):
    assert orders.columns == ["order_id", "customer_id", "order_date", "sku", "price"]
    assert orders.count() == N
    first, last = orders.agg(F.min("order_date"), F.max("order_date")).first()
    assert (first, last) == ("2020-01-01 00:00:00", "2020-01-01 00:06:39")


def test_shares(orders):
    total = sum(CUSTOMER_WEIGHTS.values())
    counts = {r[0]: r[1] for r in orders.groupBy("customer_id").count().collect()}
    assert counts[None] / N == pytest.approx(0.05, abs=0.005)
    for name, weight in CUSTOMER_WEIGHTS.items():
        assert counts[name] / N == pytest.approx(0.95 * weight / total, abs=0.01)


def test_category_distributions(orders):
    total = sum(c.weight for c in CATEGORIES.values())
    step = (F.substring_index("sku", "-", -1).cast("int") / 9973).cast("int")
    stats = {
        r.prefix: r
        for r in orders.withColumn("step", step)
        .groupBy(F.substring("sku", 1, 2).alias("prefix"))
        .agg(F.count("*").alias("n"), F.avg("price").alias("mean"), F.stddev("price").alias("std"),
             F.avg("step").alias("step"), F.min("step").alias("low"))
        .collect()
    }
    for c in CATEGORIES.values():
        r = stats[c.sku_prefix]
        assert r.n / N == pytest.approx(c.weight / total, abs=0.01)
        assert r["mean"] == pytest.approx(c.price_mean, rel=0.01)
        assert r["std"] == pytest.approx(c.price_std, rel=0.05)
        rounded_mean = math.exp(-c.sku_rate / 2) / (1 - math.exp(-c.sku_rate))
        assert r.low == 1 and r.step == pytest.approx(1 + rounded_mean, rel=0.05)


def test_draws_do_not_depend_on_partitioning(spark):
    wide = ops.synthetic_orders(spark, 500, seed=1)
    narrow = ops.order_fields(
        spark.range(0, 500, 1, 1).withColumnRenamed("id", "order_id"), "order_id", F.lit("2020-01-01").cast("timestamp"), 1
    )
    pick = ["order_id", "customer_id", "sku", "price"]
    assert {tuple(r) for r in wide.select(pick).collect()} == {tuple(r) for r in narrow.select(pick).collect()}
    other = ops.synthetic_orders(spark, 500, seed=2)
    assert other.select("sku").collect() != wide.select("sku").collect()


def test_reports(spark, orders):
    assert ops.clean_orders(orders).filter("customer_id IS NULL").isEmpty()
    top = ops.top_sku(orders, k=3).collect()
    assert len(top) == 3 and top[0].sold >= top[1].sold >= top[2].sold
    states = spark.createDataFrame([(c, "N" if i % 2 else "S") for i, c in enumerate(CUSTOMER_WEIGHTS)], "c string, state string")
    revenue = ops.revenue_by_state(orders, states, "customer_id", "price", "c", "state").collect()
    expected = orders.filter("customer_id IS NOT NULL").agg(F.sum("price"), F.count("*")).first()
    assert sum(r.revenue for r in revenue) == pytest.approx(expected[0])
    assert sum(r.orders for r in revenue) == expected[1]


def test_top_sku_breaks_ties_by_sku(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "sku string")
    assert [r.sku for r in ops.top_sku(df, k=2).collect()] == ["c", "a"]


def test_customers_are_summed_before_the_join(spark):
    orders = spark.sql("SELECT IF(id % 3 = 0, 0, id) AS c, 1 AS price FROM range(3000)")
    people = spark.sql("SELECT id AS k, 'x' AS state FROM range(3000)")
    plan = ops.revenue_by_state(orders, people, "c", "price", "k", "state")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "Aggregate" in plan[join:]
