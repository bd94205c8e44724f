"""Decimal arithmetic that rounds half up, and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(30,10)"


def exact(x: Column) -> Column:
    return x.cast(_WIDE)


def half_up(x: Column, places: int) -> Column:
    """Rounded half up as the decimal that the number shows, not as its binary value."""
    return F.round(x.cast("string").cast(_WIDE), places)


def divide(a: Column, b: Column, places: int = 10) -> Column:
    """A quotient rounded half up; 0 if the divisor is 0."""
    return F.when(exact(b) == 0, F.lit(0).cast(_WIDE)).otherwise(F.round(exact(a) / exact(b), places)).cast(_WIDE)


def clamp(x: Column, low: int | float, high: int | float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def whole_days(a: Column, b: Column) -> Column:
    """Whole stretches of 24 hours between two timestamps, without sign."""
    return F.expr("1") * F.floor(F.abs(F.unix_millis(a) - F.unix_millis(b)) / 86_400_000)


def distance_text(start: Column, end: Column) -> Column:
    """``d天h小时m分钟`` between two timestamps."""
    minutes = F.floor((F.unix_millis(end) - F.unix_millis(start)) / 60_000)
    return F.concat(
        F.floor(minutes / 1440).cast("string"), F.lit("天"),
        F.floor(minutes % 1440 / 60).cast("string"), F.lit("小时"), (minutes % 60).cast("string"), F.lit("分钟"),
    )


def parse_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern that reads the text as a timestamp; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])
