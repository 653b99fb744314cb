"""Rounding that does not depend on the order in which a cluster adds values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(col: Column, places: int) -> Column:
    """Half-even rounding of an aggregate.

    A first rounding to nine places drops the summation noise that would otherwise
    push a value lying exactly between two results to either side.
    """
    return F.bround(F.round(col, 9), places)
