"""Rounding of floats that stand for decimal amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOISE_DIGITS = 9


def round_to(col: str | Column, digits: int) -> Column:
    """Half away from zero on the decimal value.

    Credits and percentages are decimals; as floats 12.75 of 20 is 63.74999999999999 %, and
    the order of a distributed sum moves its last bits.  Cutting that noise first gives the
    decimal result, the same on every run.  A double has about 16 digits, so the value is carried as a
    decimal of 9 places and rounded once; what does not fit into it is rounded as it stands.
    """
    value = F.col(col) if isinstance(col, str) else col
    exact = value.try_cast(f"decimal(38, {_NOISE_DIGITS})")
    return F.coalesce(F.round(exact, digits).cast("double"), F.round(value.cast("double"), digits))
