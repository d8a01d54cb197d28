"""Read-side predicates. All are built-in expressions, so scans get them pushed."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.times import NANOS_PER_DAY
from metricloom.operators.catalogue import ATTRIBUTE_SCOPES

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def where_metric(series: DataFrame, name: str) -> DataFrame:
    """Series of one metric name."""
    return series.filter(F.col("MetricName") == name)


def where_service(series: DataFrame, name: str) -> DataFrame:
    """Series of one service."""
    return series.filter(F.col("ServiceName") == name)


def where_series(points: DataFrame, ids: int | Iterable[int]) -> DataFrame:
    """Rows of one SeriesID or of a short list of them."""
    if isinstance(ids, int):
        return points.filter(F.col("SeriesID") == F.lit(ids))
    return points.filter(F.col("SeriesID").isin(*ids))


def to_nanos(moment: datetime | int) -> int:
    """Nanoseconds of a moment; a datetime without a zone is UTC."""
    if isinstance(moment, int):
        return moment
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return (aware - _EPOCH) // timedelta(microseconds=1) * 1000


def time_range(points: DataFrame, start: datetime | int, end: datetime | int) -> DataFrame:
    """Points with ``start <= time <= end``.

    The range is stated on the exact nanoseconds and again on the day, which
    is the partition column: without the second predicate no partition of the
    table would be skipped.
    """
    first, last = to_nanos(start), to_nanos(end)
    days = [(_EPOCH + timedelta(days=n // NANOS_PER_DAY)).date() for n in (first, last)]
    return points.filter(
        F.col("TimeUnixNano").between(F.lit(first), F.lit(last))
        & F.col("TimeDate").between(F.lit(days[0]), F.lit(days[1]))
    )


def attribute_predicate(scope: str, key: str, value: str | None = None) -> Column:
    """The series has the attribute key, or the key with this value."""
    attributes = F.col(ATTRIBUTE_SCOPES[scope])
    if value is None:
        return F.map_contains_key(attributes, key)
    return F.coalesce(F.try_element_at(attributes, F.lit(key)) == value, F.lit(False))


def where_attribute(
    series: DataFrame, scope: str, key: str, value: str | None = None
) -> DataFrame:
    """Series by a resource, scope or point attribute."""
    return series.filter(attribute_predicate(scope, key, value))


def indexed_series(
    index: DataFrame, scope: str, key: str, value: str | None = None
) -> DataFrame:
    """C8 through I2: SeriesIDs from the attribute index, with pushed predicates."""
    hits = index.filter((F.col("scope") == scope) & (F.col("key") == key))
    return (hits if value is None else hits.filter(F.col("value") == value)).select("SeriesID")
