"""Column functions on the closed track: distances and marshal sectors wrap at the line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def circ(d, length) -> Column:
    """Signed circular difference, from -length/2 up to length/2."""
    d, length = _c(d), _c(length)
    return F.pmod(d + length / 2, length) - length / 2


def sector_offset(car, flagged, n) -> Column:
    """Sectors from the flagged one to the car's, downstream positive."""
    car, flagged, n = _c(car), _c(flagged), _c(n)
    half = F.floor(n / 2)
    return (F.pmod(car - flagged + half, n) - half).cast("int")


def sector_matches(car, flagged, n) -> Column:
    """Race control flags the sectors approaching an incident: up to 2 downstream, 1 upstream."""
    return sector_offset(car, flagged, n).between(-1, 2)


def near_sector(a, b, n) -> Column:
    """Same or adjacent sector."""
    return F.abs(sector_offset(a, b, n)) <= 1


def risk_level(r) -> Column:
    r = _c(r)
    return (F.when(r >= RISK_HIGH, "high").when(r >= RISK_HIGH / 3, "elevated").otherwise("low"))


def race_laps(length, is_monaco) -> Column:
    """Scheduled laps: the fewest that cover the race distance; NULL for an implausible lap."""
    distance = F.when(_c(is_monaco), F.lit(260000.0)).otherwise(F.lit(305000.0))
    return F.when(_c(length) >= 1000.0, F.ceil(distance / _c(length)).cast("int"))


RISK_HIGH = 0.027
