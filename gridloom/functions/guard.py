"""Errors of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finer(own: Column, res: int, value: Column) -> Column:
    """``value``, or an error for a cell whose resolution is not coarser than ``res``."""
    return F.when(own >= res, F.raise_error(F.concat(F.lit(f"resolution {res} is not finer than the cell's own, "), own.cast("string")))).otherwise(value)
