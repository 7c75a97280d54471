"""Batch sinks."""

from tidemark.sinks.files import write_json_events, write_partitioned_parquet
from tidemark.sinks.scripts import read_scripts, run_scripts, script_log
from tidemark.sinks.tables import add_partitions, register_external_table, table_partitions

__all__ = [
    "add_partitions",
    "read_scripts",
    "register_external_table",
    "run_scripts",
    "script_log",
    "table_partitions",
    "write_json_events",
    "write_partitioned_parquet",
]
