"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(x: Column, places: int = 3) -> Column:
    """Cut off after some places; rounded to nine places first, so float noise doesn't decide."""
    return F.floor(F.round(x, 9) * 10**places) / float(10**places)


def amplify(weight: Column, power: float = 2.5) -> Column:
    """Signed power of a weight."""
    return F.signum(weight) * F.pow(F.abs(weight), F.lit(power))


def significance(shared: Column, full: int = 50) -> Column:
    """One fiftieth for weights that rest on fewer than ``full`` common ratings, else one."""
    return F.when(shared < full, F.lit(1.0 / full)).otherwise(F.lit(1.0))


def ratio(a: Column, b: Column, otherwise: Column | float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is zero or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise) if isinstance(otherwise, (int, float)) else otherwise)


def linear_hash(x: Column, a: int, b: int, p: Column | int) -> Column:
    return F.pmod(F.lit(a) * x + F.lit(b), p if isinstance(p, Column) else F.lit(p))
