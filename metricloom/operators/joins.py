"""Points and the catalogue, joined on SeriesID."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame

from metricloom.operators.catalogue import compact_series
from metricloom.operators.filters import time_range, where_series


def enrich(points: DataFrame, series: DataFrame, compacted: bool = False) -> DataFrame:
    """points with the metadata of their series (inner join).

    The catalogue is compacted first, so its unmerged versions cannot multiply
    points; say ``compacted`` if it has one row per series already. Spark
    broadcasts it when its measured size is under the session threshold.
    Beyond that both sides shuffle, and one series may own a third of all
    points: the rebalance puts an exchange between the compaction and the
    join, so that adaptive execution can split the points of a hot series,
    and repeats only that series' catalogue row.
    """
    catalogue = series if compacted else compact_series(series)
    return points.join(catalogue.hint("rebalance"), "SeriesID")


def orphans(points: DataFrame, series: DataFrame) -> DataFrame:
    """points whose SeriesID is not in the catalogue."""
    return points.join(series.select("SeriesID"), "SeriesID", "left_anti")


def points_of(points: DataFrame, ids: DataFrame) -> DataFrame:
    """points whose SeriesID is in ``ids``; duplicates there do no harm."""
    return points.join(ids.select("SeriesID"), "SeriesID", "left_semi")


def points_where(points: DataFrame, series: DataFrame, predicate: Column) -> DataFrame:
    """points of the series that match a catalogue predicate."""
    return points_of(points, series.filter(predicate))


def series_over_time(
    points: DataFrame, ids: int | Iterable[int] | DataFrame, start: datetime | int, end: datetime | int
) -> DataFrame:
    """points of some series in a time range, in storage order.

    ``ids`` is one ID, a short list, or a DataFrame of any number of them.
    """
    own = points_of(points, ids) if isinstance(ids, DataFrame) else where_series(points, ids)
    return time_range(own, start, end).orderBy("SeriesID", "TimeUnixNano")
