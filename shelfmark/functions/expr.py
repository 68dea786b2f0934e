"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and written once into the plan.

    A Column that is used several times is copied each time; nested helpers so grow beyond
    what compiles. A lambda's variable isn't copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
