"""Identifier rules shared by all operators on triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(col: Column | str) -> Column:
    """Trimmed of blanks, tabs and line ends and put in upper case; null where nothing is left."""
    value = F.col(col) if isinstance(col, str) else col
    trimmed = F.upper(F.regexp_replace(value.cast("string"), r"^[\s ]+|[\s ]+$", ""))
    return F.when(trimmed != "", trimmed)
