"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
