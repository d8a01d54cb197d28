"""Nanosecond times. Nothing here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_DAY = 86_400_000_000_000


def _floor_div(value: str, divisor: int) -> str:
    # Integer division truncates towards zero; step down for negative remainders.
    return f"({value} div {divisor}L - if({value} % {divisor}L < 0, 1, 0))"


def _floored(value: Column, divisor: int) -> Column:
    whole = F.call_function("div", value, F.lit(divisor).cast("bigint"))
    return whole - F.when(value % F.lit(divisor) < 0, 1).otherwise(0)


def nanos_to_timestamp_sql(nanos: str) -> str:
    """SQL of K7, timestamp."""
    return f"timestamp_micros({_floor_div(nanos, 1000)})"


def nanos_to_date_sql(nanos: str) -> str:
    """SQL of K7, date."""
    return f"date_from_unix_date(cast({_floor_div(nanos, NANOS_PER_DAY)} as int))"


def nanos_to_timestamp(nanos: Column) -> Column:
    """K7: microsecond timestamp of a nanosecond time, rounded down."""
    return F.timestamp_micros(_floored(nanos, 1000))


def nanos_to_date(nanos: Column) -> Column:
    """K7: UTC day of a nanosecond time."""
    return F.date_from_unix_date(_floored(nanos, NANOS_PER_DAY).cast("int"))


def unix_nanos(point_time: str = "TimeUnixNano") -> Column:
    """The exact nanosecond sort key of a stored point."""
    return F.col(point_time)
