"""Named checks: one query per operator over the test tables, with the same result in plain SQL."""

from tidemark.registry.oracle import ORACLE
from tidemark.registry.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
