"""Name an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Array functions evaluate a shared argument at every mention; a one-element transform
    gives it a name.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
