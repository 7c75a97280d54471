"""DataFrame-to-DataFrame operators."""

from tidemark.operators.detections import (
    OBJECT_NAMES,
    batch_record_count,
    best_score_per_class,
    best_scores_in_record,
    decode_payload,
    explode_predictions,
    label_lookup,
    score_threshold,
)
from tidemark.operators.drift import field_types, merged_schema, schema_drift
from tidemark.operators.metrics import (
    alarm_states,
    m_of_n_alarm,
    per_minute_lag,
    per_minute_sums,
    period_averages,
)
from tidemark.operators.nested import flatten_columns, flatten_paths
from tidemark.operators.notices import (
    distinct_notices,
    read_notices,
    require_fields,
    row_to_event,
    split_images,
    unnest_notifications,
)
from tidemark.operators.orders import clean_orders, order_fields, revenue_by_state, synthetic_orders, top_sku
from tidemark.operators.partitions import (
    SENSOR_RANGES,
    distinct_partitions,
    distinct_time_partitions,
    normalise_partition_keys,
    expected_hours,
    partition_gaps,
    partition_grid,
    partition_values_from_path,
    stale_partitions,
    time_partition_columns,
)
from tidemark.operators.profile import table_profile
from tidemark.operators.shape import apply_mapping, drop_null_fields, resolve_choice

__all__ = [
    "field_types",
    "merged_schema",
    "schema_drift",
    "distinct_notices",
    "OBJECT_NAMES",
    "SENSOR_RANGES",
    "alarm_states",
    "apply_mapping",
    "batch_record_count",
    "best_score_per_class",
    "best_scores_in_record",
    "clean_orders",
    "decode_payload",
    "distinct_partitions",
    "distinct_time_partitions",
    "drop_null_fields",
    "explode_predictions",
    "flatten_columns",
    "flatten_paths",
    "label_lookup",
    "m_of_n_alarm",
    "normalise_partition_keys",
    "order_fields",
    "expected_hours",
    "partition_gaps",
    "partition_grid",
    "partition_values_from_path",
    "per_minute_lag",
    "per_minute_sums",
    "period_averages",
    "read_notices",
    "require_fields",
    "resolve_choice",
    "revenue_by_state",
    "row_to_event",
    "score_threshold",
    "split_images",
    "stale_partitions",
    "synthetic_orders",
    "table_profile",
    "time_partition_columns",
    "top_sku",
    "unnest_notifications",
]
