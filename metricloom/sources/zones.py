"""Which files of a point table can hold some series in some time."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.operators.filters import time_range, to_nanos, where_series
from metricloom.operators.joins import points_of
from metricloom.schema import POINTS, ZONES
from metricloom.sources import manifest
from metricloom.sources.manifest import commit, live, load, new_write_id
from metricloom.sources.tables import put_rows, read_points, read_writes, scan_points

# Leading bits of a SeriesID by which files and IDs are brought together.
PREFIX_BITS = 8


def _zones_of(table: str) -> str:
    return f"zones_{table}"


def _uncovered(state: dict, table: str) -> list[int]:
    covered = {n for w in live(state, _zones_of(table)) for n in w["covers"]}
    return [w["id"] for w in live(state, table) if w["id"] not in covered]


def write_zone_map(spark: SparkSession, base: str, table: str) -> None:
    """Note the range of SeriesIDs and times of every file of a point table that came since the last time.

    Two columns of those files are read, and nothing of the files noted before. Best done after a merge: merged
    files are sorted by SeriesID within their day and hold a narrow range of them.
    """
    ids = _uncovered(load(spark, base), table)
    if not ids:
        return
    write_id = new_write_id()
    points = read_points(spark, base, table, ids)
    zones = points.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("SeriesID").alias("min_id"),
        F.max("SeriesID").alias("max_id"),
        F.min("TimeUnixNano").alias("min_nanos"),
        F.max("TimeUnixNano").alias("max_nanos"),
        F.count(F.lit(1)).alias("rows"),
    )
    path = F.regexp_extract("file", "(write=[0-9]+/table=.*)$", 1)
    found = put_rows(
        zones.withColumn("file", path),
        f"{base}/{_zones_of(table)}/write={write_id}",
        {_zones_of(table): F.count(F.lit(1))},
    )

    def add(state: dict) -> None:
        if not set(ids) <= set(_uncovered(state, table)):
            raise manifest.Replaced(f"some of {table} has been noted or merged meanwhile")
        state["writes"].append({"id": write_id, "tables": found, "holds": {}, "covers": ids})

    commit(spark, base, add)


def _prefix(column: str):
    return F.shiftright(F.col(column), 64 - PREFIX_BITS)


def _matching(zones: DataFrame, ids: DataFrame | Iterable[int] | None, start: int | None, end: int | None):
    """Zones that overlap a time and hold at least one of the IDs between their ends."""
    if start is not None:
        zones = zones.filter(F.col("max_nanos") >= start)
    if end is not None:
        zones = zones.filter(F.col("min_nanos") <= end)
    if ids is None:
        return zones
    if not isinstance(ids, DataFrame):
        hit = F.lit(False)
        for one in ids:
            hit = hit | F.lit(one).between(F.col("min_id"), F.col("max_id"))
        return zones.filter(hit)
    # A file meets the IDs of the prefixes that its range spans: an equality to join by.
    spread = zones.withColumn("_prefix", F.explode(F.sequence(_prefix("min_id"), _prefix("max_id"))))
    wanted = ids.select(F.col("SeriesID").alias("_id"), _prefix("SeriesID").alias("_of"))
    inside = (F.col("_prefix") == F.col("_of")) & F.col("_id").between(F.col("min_id"), F.col("max_id"))
    return spread.join(wanted, inside, "left_semi").select("file").distinct()


def scan_points_of(
    spark: SparkSession,
    base: str,
    table: str,
    ids: DataFrame | Iterable[int] | None = None,
    start: datetime | int | None = None,
    end: datetime | int | None = None,
) -> DataFrame:
    """Points of some series in some time, from the files that can hold them; no others are listed.

    ``ids`` is a DataFrame with SeriesIDs, of any size, or a short list of them. Files that the zone map
    does not know yet are read as a whole table is. What reaches the driver are the
    names of the files to be read, which Spark lists there for any scan.
    """
    first, last = (None if t is None else to_nanos(t) for t in (start, end))
    state = load(spark, base)
    ids = ids if ids is None or isinstance(ids, DataFrame) else list(ids)
    known = [w["id"] for w in live(state, _zones_of(table))]
    present = {w["id"] for w in live(state, table)}
    rest = _uncovered(state, table)
    names: list[str] = []
    if known:
        zones = read_writes(spark, f"{base}/{_zones_of(table)}", known, ZONES)
        matching = _matching(zones, ids, first, last).select("file").collect()
        names = [r.file for r in matching if int(r.file.split("/")[0].removeprefix("write=")) in present]
    paths = [f"{base}/points/{name}" for name in names]
    paths += [f"{base}/points/write={n}/table={table}" for n in rest]
    if not paths:
        return scan_points(spark, base, table).filter("false")
    schema = f"{POINTS[table]}, TimeDate DATE, write BIGINT"
    points = spark.read.schema(schema).option("basePath", f"{base}/points").parquet(*paths)
    points = points.drop("write", "table")
    if first is not None or last is not None:
        points = time_range(
            points, -(2**63) if first is None else first, 2**63 - 1 if last is None else last
        )
    if ids is None:
        return points
    return points_of(points, ids) if isinstance(ids, DataFrame) else where_series(points, ids)
