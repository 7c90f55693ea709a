"""Naming an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it.

    Without it, an expression used five times at each of six levels is written out 5^6 times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
