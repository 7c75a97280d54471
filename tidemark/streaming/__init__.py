"""Structured Streaming sources and landing."""

from tidemark.streaming.alarms import read_alarms, stream_alarm
from tidemark.streaming.landing import (
    BUFFER_BYTES,
    BUFFER_INTERVAL,
    land_stream,
    route_malformed,
    stream_raw_backup,
    stream_to_parquet,
)
from tidemark.streaming.retries import read_ledger, try_records
from tidemark.streaming.sized import compact_landed, land_sized, read_landed
from tidemark.streaming.sources import order_stream, stream_source, topic_source
from tidemark.streaming.top import exact_top, merged_counts, read_summary, stream_top

__all__ = [
    "BUFFER_BYTES",
    "BUFFER_INTERVAL",
    "compact_landed",
    "exact_top",
    "land_sized",
    "land_stream",
    "merged_counts",
    "order_stream",
    "read_alarms",
    "read_landed",
    "read_ledger",
    "read_summary",
    "route_malformed",
    "stream_alarm",
    "stream_raw_backup",
    "stream_source",
    "stream_to_parquet",
    "stream_top",
    "topic_source",
    "try_records",
]
