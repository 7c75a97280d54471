"""Order stream: generator and the reports named after it."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.draws import hash_uniform, weighted_choice


class Category(NamedTuple):
    weight: int
    sku_prefix: str
    sku_rate: float
    price_mean: float
    price_std: float


# Popularity, SKU and price distribution per category; customer weights;
# share of orders without a customer; SKU step; orders per tick and ticks per second.
CATEGORIES = {
    "Clothing_shoes_and_accessories": Category(44, "CS", 1 / 3, 120, 10),
    "Electronics": Category(34, "ET", 1 / 4, 500, 50),
    "Beauty_and_personal_care_items": Category(29, "BT", 1 / 5, 50, 5),
    "Books_music_and_movies": Category(44, "BO", 1 / 6, 30, 3),
    "Flowers_and_gifts": Category(14, "FG", 1 / 2, 20, 2),
}
CUSTOMER_WEIGHTS = {"customer-1": 44, "customer-2": 34, "customer-3": 29, "customer-4": 44, "customer-5": 14}
ANONYMOUS_SHARE = 0.05
SKU_STEP = 9973
ORDERS_PER_TICK = 15
TICKS_PER_SECOND = 10

Uniform = Callable[[Column, int, int], Column]


def _by_category(pick: Callable[[Category], Column | float | str]) -> Column:
    chosen = None
    for name, spec in CATEGORIES.items():
        hit, value = F.col("_category") == name, pick(spec)
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen


def order_fields(
    df: DataFrame,
    row_id: str,
    order_time: Column,
    seed: int = 0,
    customers: Mapping[str, float] = CUSTOMER_WEIGHTS,
    uniform: Uniform = hash_uniform,
) -> DataFrame:
    """Draw one order ``(customer_id, order_date, sku, price)`` per row; other columns are kept.

    Category and customer follow their weights, a few orders have no customer, SKU
    numbers are exponential and prices normal within the category. Draws depend on
    the row id only, so a retried task gives the same orders.
    """
    keep = df.columns
    # Draws get columns of their own, or each branch of a choice would compute them again.
    drawn = df.select("*", *[uniform(F.col(row_id), seed, draw).alias(f"_u{draw}") for draw in range(6)])
    u = [F.col(f"_u{draw}") for draw in range(6)]
    drawn = drawn.select(
        "*",
        weighted_choice(u[0], {n: c.weight for n, c in CATEGORIES.items()}).alias("_category"),
        F.when(u[1] > ANONYMOUS_SHARE, weighted_choice(u[2], customers)).alias("customer_id"),
        (-F.log(u[3])).alias("_exponential"),
        (F.sqrt(-2.0 * F.log(u[4])) * F.cos(2.0 * math.pi * u[5])).alias("_normal"),
    )
    number = (1 + F.round(F.col("_exponential") / _by_category(lambda c: c.sku_rate)).cast("bigint")) * SKU_STEP
    sku = F.concat(_by_category(lambda c: c.sku_prefix), F.lit("-"), number.cast("string"))
    mean, std = _by_category(lambda c: float(c.price_mean)), _by_category(lambda c: float(c.price_std))
    return drawn.select(
        *keep,
        "customer_id",
        F.date_format(order_time, "yyyy-MM-dd HH:mm:ss").alias("order_date"),
        sku.alias("sku"),
        (mean + std * F.col("_normal")).alias("price"),
    )


def synthetic_orders(
    spark: SparkSession, n: int, seed: int = 0, start: datetime = datetime(2020, 1, 1), **options
) -> DataFrame:
    """``n`` orders, spaced as the generator emits them, starting at a given time."""
    per_second = ORDERS_PER_TICK * TICKS_PER_SECOND
    seconds = F.floor(F.col("order_id") / per_second)
    order_time = F.timestamp_add("SECOND", seconds, F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
    return order_fields(spark.range(n).withColumnRenamed("id", "order_id"), "order_id", order_time, seed, **options)


def clean_orders(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Orders that have a customer."""
    return df.filter(F.col(customer).isNotNull())


def revenue_by_state(
    orders: DataFrame,
    customers: DataFrame,
    order_customer: str,
    value: str,
    customer_key: str,
    state: str,
) -> DataFrame:
    """Order value per state of the customer.

    Orders are summed per customer before the join, so a customer with a third of
    all orders joins as a single row.
    """
    totals = orders.groupBy(F.col(order_customer).alias("_customer")).agg(
        F.sum(value).alias("_revenue"), F.count("*").alias("_orders")
    )
    people = customers.select(F.col(customer_key).alias("_customer"), F.col(state))
    return (
        totals.join(people, "_customer")
        .groupBy(state)
        .agg(F.sum("_revenue").alias("revenue"), F.sum("_orders").alias("orders"))
    )


def top_sku(df: DataFrame, sku: str = "sku", k: int = 10) -> DataFrame:
    """The ``k`` most sold SKUs, ties in SKU order."""
    counted = df.groupBy(sku).agg(F.count("*").alias("sold"))
    return counted.orderBy(F.col("sold").desc(), F.col(sku)).limit(k)
