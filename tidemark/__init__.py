"""Spark-native operators for a sensor and event data lake."""

from tidemark.session import build_session, clear_scratch, scratch_dir

__all__ = ["build_session", "clear_scratch", "scratch_dir"]
