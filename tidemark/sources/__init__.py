"""Batch sources."""

from tidemark.sources.files import (
    later_folders,
    object_listing,
    projected_glob,
    scan_csv_header,
    scan_headed_files,
    scan_inferred_json,
    scan_partitioned_json,
)
from tidemark.sources.records import decode_typed_attributes, scan_change_images

__all__ = [
    "decode_typed_attributes",
    "later_folders",
    "object_listing",
    "projected_glob",
    "scan_change_images",
    "scan_csv_header",
    "scan_headed_files",
    "scan_inferred_json",
    "scan_partitioned_json",
]
