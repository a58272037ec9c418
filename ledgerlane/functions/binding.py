"""Binding of a value that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and written once in the plan.

    Columns are expression trees: using one in five places copies it five times, and copies of copies grow without bound.
    A lambda's variable is one node. Python UDFs may not stand inside the body.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
