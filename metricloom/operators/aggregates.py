"""Counts over series, points, rejects, requests and the write ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.schema import POINT_TABLES


def count_all(rows: DataFrame, name: str = "points") -> DataFrame:
    """Number of rows."""
    return rows.agg(F.count(F.lit(1)).alias(name))


def requests_received(requests: DataFrame) -> DataFrame:
    """Number of requests, before any flattening."""
    return count_all(requests, "requests")


def count_series(series: DataFrame, predicate: Column) -> DataFrame:
    """G1: number of series rows that match a predicate."""
    return count_all(series.filter(predicate), "series")


def count_points(points: DataFrame, series: DataFrame, predicate: Column) -> DataFrame:
    """Number of points whose series matches, through the join.

    Points are counted per series before the join, so one row per series and
    map task is shuffled, however many points a series has. ``series`` holds
    one row per SeriesID.
    """
    per_series = points.groupBy("SeriesID").agg(F.count(F.lit(1)).alias("n"))
    matched = per_series.join(series.filter(predicate).select("SeriesID"), "SeriesID")
    return matched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"))


def processed_by_type(mapped: dict[str, DataFrame]) -> DataFrame:
    """Accepted points per metric type; a type without points has no row."""
    parts = [
        mapped[table].select(F.lit(metric_type).alias("MetricType"))
        for table, (metric_type, _, _) in POINT_TABLES.items()
        if table in mapped
    ]
    return reduce(DataFrame.unionAll, parts).groupBy("MetricType").agg(
        F.count(F.lit(1)).alias("points")
    )


def skipped_by_reason(rejects: DataFrame) -> DataFrame:
    """Rejects per reason."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rejects"))


def series_hit_miss(series: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue hits and misses of a batch of series rows.

    The first row of an ID that is not stored yet is a miss, every other row a
    hit. Rows are counted per ID before the join.
    """
    per_id = series.groupBy("SeriesID").agg(F.count(F.lit(1)).alias("n"))
    stored = catalogue.select("SeriesID", F.lit(True).alias("known"))
    # One catalogue row per ID: a set, so versions cannot multiply the counts.
    seen = per_id.join(stored.dropDuplicates(["SeriesID"]), "SeriesID", "left")
    return seen.agg(
        F.coalesce(F.sum("n") - F.count_if(F.col("known").isNull()), F.lit(0)).alias("hits"),
        F.count_if(F.col("known").isNull()).alias("misses"),
    )


def batch_sizes(ledger: DataFrame) -> DataFrame:
    """Rows written per batch of a writer and table; of several attempts the one that succeeded."""
    return (
        ledger.filter(F.col("error").isNull())
        .groupBy("writer", "batch_id", "table")
        .agg(F.max("rows").alias("rows"))
    )


def write_stats(ledger: DataFrame) -> DataFrame:
    """Attempted writes, failures, rows and duration per table.

    Every attempt counts with its duration, which the tables of one job share; the
    rows of a batch that was written again count once.
    """
    failed = F.col("error").isNotNull()
    per_batch = ledger.groupBy("table", "writer", "batch_id").agg(
        F.count(F.lit(1)).alias("writes"),
        F.count_if(failed).alias("failures"),
        F.max(F.when(~failed, F.col("rows")).otherwise(0)).alias("rows"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    return per_batch.groupBy("table").agg(
        F.sum("writes").alias("writes"),
        F.sum("failures").alias("failures"),
        F.sum("rows").alias("rows"),
        F.sum("total_ms").alias("total_ms"),
        F.max("max_ms").alias("max_ms"),
    )
