"""Whole jobs put together from the operators."""

from tidemark.plans.jobs import (
    SENSOR_MAPPING,
    curate,
    detections_report,
    ingest_uploads,
    refresh_tables,
)

__all__ = ["SENSOR_MAPPING", "curate", "detections_report", "ingest_uploads", "refresh_tables"]
