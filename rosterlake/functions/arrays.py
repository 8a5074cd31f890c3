"""Column functions on sorted arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_while(values: Column, holds: Callable[[Column], Column]) -> Column:
    """How many elements a sorted array has at its beginning for which a condition holds, by bisection; 0 for an empty one.

    The condition must hold for a first part of the array and for nothing after it.
    """
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(values)) & holds(F.get(values, at + step - 1)), at + step).otherwise(at))
