"""The series catalogue as sets of rows keyed by SeriesID."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from metricloom.schema import SERIES, column_names

# Scope label in the attribute index -> catalogue column.
ATTRIBUTE_SCOPES = {
    "resource": "ResourceAttributes",
    "scope": "ScopeAttributes",
    "point": "Attributes",
}

# Scope label of the rows of a stored index part that name its series.
INDEXED = "series"


def distinct_series(series: DataFrame) -> DataFrame:
    """One row per SeriesID, any of its rows. Combines before the shuffle.

    Rows of one series may differ in the metadata that is not part of the
    identity; where the survivor must not depend on chance, use ``compact_series``.
    """
    return series.dropDuplicates(["SeriesID"])


def distinct_rows(series: DataFrame) -> DataFrame:
    """Every different row once, for rows that repeat much, such as one per point.

    All columns are grouping keys, so it is a hash aggregation that combines before the shuffle and
    sorts nothing: a task holds each different row once. Maps are compared by their entries as they stand.
    """
    maps = [f.name for f in series.schema if isinstance(f.dataType, MapType)]
    entries = series.withColumns({c: F.map_entries(c) for c in maps}).distinct()
    return entries.withColumns({c: F.map_from_entries(c) for c in maps})


def new_series(series: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per SeriesID that the stored catalogue does not hold.

    Which IDs are new is found on the IDs alone: they combine before the
    shuffle, and the wide rows of the many known series are dropped by a join
    with the few new ones before any of them is sorted or compacted. A replay
    finds the same rows again.
    """
    fresh = series.select("SeriesID").distinct().join(
        catalogue.select("SeriesID"), "SeriesID", "left_anti"
    )
    return compact_series(series.join(fresh.hint("rebalance"), "SeriesID", "left_semi"))


def compact_series(series: DataFrame, keep_first_seen: bool = False) -> DataFrame:
    """The newest row per SeriesID; E3b also carries the earliest FirstSeen.

    Newest is by LastSeen, then by ``write`` where the input has one, then
    by a hash of the columns that may differ between versions, so the winner
    does not depend on the order of rows. It is an aggregation, not a window:
    partial results are combined before the shuffle, so a SeriesID that owns a
    third of all rows costs the reducer one row per map task.
    """
    version = ["LastSeen"] + (["write"] if "write" in series.columns else [])
    tie = F.xxhash64(
        "MetricDescription", "MetricUnit", "ServiceName", "ScopeSchemaUrl",
        "ScopeDroppedAttrCount", "FirstSeen", F.sort_array(F.map_entries("ScopeAttributes")),
    )
    columns = column_names(SERIES)
    newest = series.groupBy("SeriesID").agg(
        F.max_by(
            F.struct(*[c for c in columns if c != "SeriesID"]), F.struct(*version, tie)
        ).alias("row"),
        *([F.min("FirstSeen").alias("earliest")] if keep_first_seen else []),
    )
    first_seen = F.col("earliest") if keep_first_seen else F.col("row.FirstSeen")
    return newest.select(
        *[
            first_seen.alias(c) if c == "FirstSeen" else F.col(c if c == "SeriesID" else f"row.{c}")
            for c in columns
        ]
    )


def attribute_index(series: DataFrame) -> DataFrame:
    """One row per (scope, key, value, SeriesID) of the three attribute maps.

    Expects one row per series, as ``compact_series`` gives.
    """
    sides = F.array(
        *[
            F.struct(F.lit(label).alias("scope"), F.col(column).alias("attributes"))
            for label, column in ATTRIBUTE_SCOPES.items()
        ]
    )
    return series.select("SeriesID", F.inline(sides)).select(
        "scope", F.explode("attributes").alias("key", "value"), "SeriesID"
    )
