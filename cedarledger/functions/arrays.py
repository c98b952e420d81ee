"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
