"""Numeric helpers that give identical results in every IEEE-754 engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, ColumnOrName


def round_half_up(c: ColumnOrName, digits: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d as a double.

    Written out instead of ``round`` so that Spark, DuckDB and pandas agree
    bit-for-bit (``round`` differs between engines on binary ties).  From
    2^52 / 10^d on a double has no such digits: those values, infinities and
    NaN come back as they are (``floor`` gives a long)."""
    scale = float(10 ** digits)
    x = _c(c).cast("double")
    return F.when(F.abs(x) < 2.0 ** 52 / scale, F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(x)
