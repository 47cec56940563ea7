"""Numbers in sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(c: Column | str, nd: int = 0, sign: bool = False) -> Column:
    """The number with `nd` decimals, exact halves to the even digit."""
    return F.format_string(f"%{'+' if sign else ''}.{nd}f", F.bround(c, nd).cast("double"))


def settled(c: Column | str, nd: int) -> Column:
    """Rounded; interpolated values that only just miss an exact half count as the half."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, nd)
