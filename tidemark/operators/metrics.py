"""Per-minute metrics and the M-of-N alarm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metric period and alarm rule.
METRIC_PERIOD = "1 minute"
ALARM_PERIOD = "5 minutes"
ALARM_POINTS = 2
ALARM_PERIODS = 5
ALARM_THRESHOLD = 60.0


def per_minute_sums(
    df: DataFrame, ts: str, keys: Sequence[str], value: str, watermark: str | None = None
) -> DataFrame:
    """Records and bytes per key and minute. Works on a batch and on a stream.

    A stream needs ``watermark`` to append closed minutes.
    """
    if watermark:
        df = df.withWatermark(ts, watermark)
    return (
        df.groupBy(F.window(ts, METRIC_PERIOD).alias("_w"), *keys)
        .agg(F.count("*").alias("records"), F.sum(F.octet_length(value)).alias("bytes"))
        .select(F.col("_w.start").alias("minute"), *keys, "records", "bytes")
    )


def per_minute_lag(
    df: DataFrame, event_time: str, arrival_time: str, keys: Sequence[str] = (), watermark: str | None = None
) -> DataFrame:
    """Largest and average delay in milliseconds per minute of arrival."""
    if watermark:
        df = df.withWatermark(arrival_time, watermark)
    event, arrival = F.col(event_time).cast("timestamp"), F.col(arrival_time).cast("timestamp")
    lag = F.unix_millis(arrival) - F.unix_millis(event)
    return (
        df.groupBy(F.window(arrival_time, METRIC_PERIOD).alias("_w"), *keys)
        .agg(F.max(lag).alias("max_lag_ms"), F.avg(lag).alias("avg_lag_ms"))
        .select(F.col("_w.start").alias("minute"), *keys, "max_lag_ms", "avg_lag_ms")
    )


def period_averages(
    df: DataFrame,
    ts: str,
    value: str,
    keys: Sequence[str] = (),
    period: str = ALARM_PERIOD,
    watermark: str | None = None,
) -> DataFrame:
    """Average per key and period; the part of the alarm that also runs on a stream."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    return (
        df.groupBy(F.window(ts, period).alias("_w"), *keys)
        .agg(F.avg(value).alias("average"))
        .select(F.col("_w.start").alias("period"), *keys, "average")
    )


def alarm_states(
    averages: DataFrame,
    keys: Sequence[str] = (),
    m: int = ALARM_POINTS,
    n: int = ALARM_PERIODS,
    threshold: float = ALARM_THRESHOLD,
) -> DataFrame:
    """Alarm state per period from averages ``(period, keys, average)``, e.g. those a stream has written.

    Periods without an average are left out, as those without data are.
    """
    averages = averages.filter(F.col("average").isNotNull())
    last_n = Window.partitionBy(*keys).orderBy("period").rowsBetween(1 - n, 0)
    breach = (F.col("average") > threshold).cast("int")
    return averages.withColumn("breaches", F.sum(breach).over(last_n)).withColumn("alarm", F.col("breaches") >= m)


def m_of_n_alarm(
    df: DataFrame,
    ts: str,
    value: str,
    keys: Sequence[str] = (),
    period: str = ALARM_PERIOD,
    m: int = ALARM_POINTS,
    n: int = ALARM_PERIODS,
    threshold: float = ALARM_THRESHOLD,
) -> DataFrame:
    """Alarm when at least ``m`` of the last ``n`` periods average strictly above the threshold.

    Periods without data are left out. Rows are averaged per period before the
    window, so a key reaches its task as one row per period (about 105,000 a year
    at five minutes) however many rows it holds.
    """
    return alarm_states(period_averages(df, ts, value, keys, period), keys, m, n, threshold)
