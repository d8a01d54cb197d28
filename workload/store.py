"""A store built from the provided tables by the ingest job, in two batches."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from metricloom import ingest_files, land_requests
from metricloom.session import scratch_path
from workload import shapes

INGEST_TIMES = [datetime(2024, 2, 1 + n, tzinfo=timezone.utc) for n in range(2)]


def store_requests(
    spark: SparkSession, sf_dir: str, part: int | None = None, sparse: bool = False
) -> list[DataFrame]:
    """Requests of the five types; ``part`` takes one of two halves that split no group.

    ``sparse`` ones have their own payload column and kinds of values, and not those that would be NULL throughout.
    """

    def half(name: str, number: str) -> DataFrame:
        rows = shapes.table(spark, sf_dir, name)
        return rows if part is None else rows.filter(f"{number} % 2 = {part}")

    return [
        shapes.gauge_requests(half("events", "event_id"), sparse=sparse),
        shapes.sum_requests(half("lineitem", "day(l_shipdate)"), sparse),
        shapes.histogram_requests(half("orders", "day(o_orderdate)"), sparse),
        shapes.exponential_requests(half("lineitem", "day(l_shipdate)"), sparse),
        shapes.summary_requests(half("orders", "month(o_orderdate)"), sparse),
    ]


@lru_cache(maxsize=8)
def _landed(application: str, sf_dir: str) -> str:
    spark = SparkSession.active()
    path = scratch_path(spark, "requests")
    for part in (0, 1):
        # Files of a type have its payload column and kinds of values alone: readers give NULL for the others.
        for requests in store_requests(spark, sf_dir, part, sparse=True):
            land_requests(requests, f"{path}/part{part}", mode="append")
    return path


@lru_cache(maxsize=8)
def _stored(application: str, sf_dir: str) -> str:
    spark = SparkSession.active()
    base = scratch_path(spark, "store")
    landed = _landed(application, sf_dir)
    for part, moment in enumerate(INGEST_TIMES):
        ingest_files(spark, f"{landed}/part{part}", base, part, moment)
    return base


def landed(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the requests as Parquet files, made once per application."""
    return _landed(spark.sparkContext.applicationId, sf_dir)


def stored(spark: SparkSession, sf_dir: str) -> str:
    """Base path of the stored tables, made once per application."""
    return _stored(spark.sparkContext.applicationId, sf_dir)
