"""Rounding and squashing of numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(c: Column, places: int, even: bool = False) -> Column:
    """c rounded through a decimal of ten places, so that ties don't hang on the last bit of a double."""
    d = c.cast("decimal(24,10)")
    return (F.bround(d, places) if even else F.round(d, places)).cast("double")


def binary_round(c: Column, places: int) -> Column:
    """c rounded half up as the double c * 10^places, as DuckDB does; F.round goes by the shortest decimal of c instead."""
    return F.round(c * float(10**places)) / float(10**places)


def sigmoid(c: Column, most: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(c, F.lit(-most)), F.lit(most))))


def logit(c: Column, least: float = 1e-6) -> Column:
    p = F.least(F.greatest(c, F.lit(least)), F.lit(1 - least))
    return F.log(p / (1 - p))


def ladder(c: Column, steps: list[tuple[float, str]], rest: str, strict: bool = True) -> Column:
    """The label of the first step that c exceeds (reaches, if not strict); steps from the highest."""
    out = F.lit(rest)
    for at, label in reversed(steps):
        out = F.when(c > at if strict else c >= at, label).otherwise(out)
    return out


def json_safe(c: Column, places: int = 6) -> Column:
    """NaN and infinities as null, the rest rounded."""
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~odd, F.round(c, places))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two closed intervals meet; a null bound is open."""
    return ~(F.coalesce(a_start > b_end, F.lit(False)) | F.coalesce(b_start > a_end, F.lit(False)))
