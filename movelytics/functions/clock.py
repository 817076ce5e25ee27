"""Clock expressions over microsecond columns (UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND


def stamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def day_number(us: Column) -> Column:
    """Whole UTC days since 1970."""
    return F.floor(us / DAY).cast("long")


def second_of_day(us: Column) -> Column:
    return F.pmod(F.floor(us / SECOND).cast("long"), F.lit(86_400))


def hour(us: Column) -> Column:
    return F.floor(second_of_day(us) / 3600).cast("int")


def minute(us: Column) -> Column:
    return F.floor(F.pmod(second_of_day(us), F.lit(3600)) / 60).cast("int")


def weekday(us: Column) -> Column:
    """Monday is 0; 1970-01-01 was a Thursday."""
    return F.pmod(day_number(us) + 3, F.lit(7)).cast("int")


def local_hour(us: Column, zone: Column) -> Column:
    return F.hour(F.from_utc_timestamp(stamp(us), zone))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    a = value * F.lit(2 * math.pi / period)
    return F.sin(a), F.cos(a)


def quarter_phase(us: Column) -> Column:
    """Seconds since the last quarter hour."""
    return F.pmod(F.floor(us / SECOND).cast("long"), F.lit(900))


def quarter_distance(us: Column) -> Column:
    p = quarter_phase(us)
    return F.least(p, F.lit(900) - p)
