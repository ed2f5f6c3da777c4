"""Small builders for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, even where ``body`` uses it inside a lambda.

    Spark evaluates an expression used inside a lambda anew for each element; a lambda's own variable it does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
