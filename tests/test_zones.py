"""The zone map: which files are listed, and that no point is missed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import metricloom as ml
from metricloom.operators.mapping import map_requests
from metricloom.sources.manifest import load
from tests.builders import T0, gauge, number, request

DAY = 86_400_000_000_000
START = (T0 // DAY + 1) * DAY  # of the second day
NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def base(spark, tmp_path, requests_of):
    """Points of 60 series over three days, merged into one file per day and range of SeriesIDs."""
    path = str(tmp_path / "store")
    ml.create_tables(spark, path)
    numbers = [number(float(i), T0 + i % 3 * DAY + i, attributes=[("k", i % 60)]) for i in range(360)]
    points = map_requests(requests_of(request(gauge("m", *numbers))), NOW)["gauge"].persist()
    for half in (0, 1):
        ml.write_points(points.filter(F.col("Value") % 2 == half), "gauge", path, half)
    # Several files a day, as large tables have.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    ml.merge_points(spark, path, "gauge")
    for name, value in before.items():
        spark.conf.set(name, value)
    return path


def files_of(frame):
    return set(frame.inputFiles())


def test_a_lookup_lists_only_files_that_can_hold_it(spark, base):
    whole = ml.scan_points(spark, base, "gauge")
    everything = files_of(whole)
    one = whole.select("SeriesID").first().SeriesID
    ids = spark.createDataFrame([(one,), (one,)], "SeriesID BIGINT")
    # Without a map all files are read, with the same points.
    assert files_of(ml.scan_points_of(spark, base, "gauge", [one])) == everything
    ml.write_zone_map(spark, base, "gauge")
    for asked in ([one], ids):
        found = ml.scan_points_of(spark, base, "gauge", asked)
        listed = files_of(found)
        assert found.count() == 6 and listed < everything and len(listed) < len(everything) / 2
        day = ml.scan_points_of(spark, base, "gauge", asked, START, START + DAY - 1)
        assert day.count() == whole.filter(F.col("SeriesID") == one).filter(f"TimeUnixNano div {DAY} = {T0 // DAY + 1}").count()
        assert files_of(day) < listed
    only_time = ml.scan_points_of(spark, base, "gauge", None, START, START + DAY - 1)
    assert only_time.count() == 120 and len({f.split("TimeDate=")[1][:10] for f in files_of(only_time)}) == 1
    none = ml.scan_points_of(spark, base, "gauge", [], T0, T0 + DAY)
    assert none.count() == 0 and none.columns == whole.columns


def test_every_series_is_found(spark, base):
    ml.write_zone_map(spark, base, "gauge")
    whole = ml.scan_points(spark, base, "gauge")
    per_series = {r.SeriesID: r["count"] for r in whole.groupBy("SeriesID").count().collect()}
    assert len(per_series) == 60
    ids = whole.select("SeriesID").distinct()
    assert ml.scan_points_of(spark, base, "gauge", ids).count() == 360
    for one in list(per_series)[:5]:
        assert ml.scan_points_of(spark, base, "gauge", [one]).count() == per_series[one]
    assert ml.scan_points_of(spark, base, "gauge", [0, -(2**63), 2**63 - 1]).count() == 0


def test_files_that_came_later_are_read_until_they_are_noted(spark, base):
    ml.write_zone_map(spark, base, "gauge")
    whole = ml.scan_points(spark, base, "gauge").persist()
    one = whole.select("SeriesID").first().SeriesID
    ml.write_points(whole, "gauge", base, 7)
    assert ml.scan_points_of(spark, base, "gauge", [one]).count() == 12
    version = load(spark, base)["version"]
    for _ in range(2):
        ml.write_zone_map(spark, base, "gauge")
        assert load(spark, base)["version"] == version + 1
    assert ml.scan_points_of(spark, base, "gauge", [one]).count() == 12
    # A merge takes over noted files: they are read no more, the merged ones until noted as a whole.
    ml.write_points(whole, "gauge", base, 8)
    ml.merge_points(spark, base, "gauge")
    ml.remove_superseded(spark, base)
    assert ml.scan_points_of(spark, base, "gauge", [one]).count() == 18
    ml.write_zone_map(spark, base, "gauge")
    assert ml.scan_points_of(spark, base, "gauge", [one]).count() == 18


def test_an_empty_table(spark, tmp_path):
    ml.create_tables(spark, str(tmp_path))
    ml.write_zone_map(spark, str(tmp_path), "sum")
    found = ml.scan_points_of(spark, str(tmp_path), "sum", [1])
    assert found.count() == 0 and found.columns == ml.scan_points(spark, str(tmp_path), "sum").columns
