"""Readers of the project's tables."""

from knotwork.sources.tables import table

__all__ = ["table"]
