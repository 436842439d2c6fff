"""Angle expressions, in radians unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(a: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(a + F.pi(), 2 * F.pi()) - F.pi()


def wrap_step(d: Column) -> Column:
    """A step between successive angles as an unwrap takes it: to [-pi, pi), but a rise by exactly pi stays pi."""
    w = wrap(d)
    return F.when((w == -F.pi()) & (d > 0), F.pi()).otherwise(w)


def circular_spread(angle: Column) -> Column:
    """Aggregate: sqrt(-2 ln R) of the mean resultant length R."""
    r = F.hypot(F.avg(F.cos(angle)), F.avg(F.sin(angle)))
    return F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(F.greatest(r, F.lit(1e-300)))))
