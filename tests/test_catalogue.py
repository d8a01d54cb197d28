"""Catalogue operators, joins and counts, with hot series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import metricloom as ml
from metricloom.operators.catalogue import distinct_rows
from metricloom.operators.mapping import map_requests
from metricloom.schema import SERIES
from tests.builders import T0, gauge, number, request

NOW = dt.datetime(2024, 1, 1)


@pytest.fixture
def mapped(requests_of):
    """One series with a third of all points, many small ones."""
    hot = [number(float(i), T0 + i, attributes=[("k", "hot")]) for i in range(100)]
    cold = [number(float(i), T0 + i, attributes=[("k", i % 40)]) for i in range(200)]
    return map_requests(requests_of(request(gauge("m", *hot, *cold))), NOW)


def version(id_, name, seen, write, description="d", first=None):
    stamp = dt.datetime(2024, 1, 1, 0, 0, seen)
    first_stamp = stamp if first is None else dt.datetime(2024, 1, 1, 0, 0, first)
    return (
        id_, "Gauge", "svc", name, description, "1", {"a": "b"}, "", "s", "1", {}, 0, "", {},
        first_stamp, stamp, write,
    )


def catalogue(spark, *rows):
    return spark.createDataFrame(list(rows), f"{SERIES}, write BIGINT")


def test_latest_row_wins_then_latest_batch(spark):
    rows = catalogue(
        spark,
        version(1, "m", 5, 0, "old"), version(1, "m", 9, 1, "new"), version(1, "m", 7, 2, "late"),
        version(2, "n", 5, 1, "second"), version(2, "n", 5, 0, "first"),
    )
    got = {r.SeriesID: r.MetricDescription for r in ml.compact_series(rows).collect()}
    assert got == {1: "new", 2: "second"}


def test_first_seen_moves_unless_kept(spark):
    rows = catalogue(spark, version(1, "m", 5, 0), version(1, "m", 9, 1))
    assert ml.compact_series(rows).first().FirstSeen.second == 9
    assert ml.compact_series(rows, keep_first_seen=True).first().FirstSeen.second == 5


def test_tie_does_not_depend_on_row_order(spark):
    a, b = version(1, "m", 5, 0, "x"), version(1, "m", 5, 0, "y")
    one = ml.compact_series(catalogue(spark, a, b)).first()
    assert one == ml.compact_series(catalogue(spark, b, a)).first()


def test_compaction_combines_before_the_shuffle(mapped):
    plan = ml.compact_series(mapped["series"])._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "partial_max_by" in below and "Window" not in plan


def test_distinct_and_new_series(mapped):
    series = mapped["series"]
    assert ml.distinct_series(series).count() == 41
    known = ml.where_attribute(series, "point", "k", "hot")
    assert ml.new_series(series, known).count() == 40
    assert ml.new_series(series, series).count() == 0


def test_hits_and_misses(mapped):
    series = mapped["series"]
    known = ml.where_attribute(series, "point", "k", "hot")
    assert tuple(ml.series_hit_miss(series, known).first()) == (260, 40)
    assert tuple(ml.series_hit_miss(series, series.filter("false")).first()) == (259, 41)
    assert tuple(ml.series_hit_miss(series.filter("false"), known).first()) == (0, 0)


def final_plan(frame):
    """The plan as adaptive execution ran it."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_enrich_keeps_every_point_once(mapped):
    points, series = mapped["gauge"], mapped["series"]
    joined = ml.enrich(points, series)
    assert joined.count() == 300
    plain = points.join(ml.compact_series(series), "SeriesID")
    columns = ["SeriesID", "TimeUnixNano", "Value", "MetricName"]
    assert joined.select(columns).exceptAll(plain.select(columns)).count() == 0
    assert ml.enrich(points, ml.compact_series(series), compacted=True).count() == 300


@pytest.fixture
def settings(spark):
    """Set session options for one test."""
    names = []

    def put(**options):
        for name, value in options.items():
            names.append(name.replace("__", "."))
            spark.conf.set(names[-1], value)

    yield put
    for name in names:
        spark.conf.unset(name)


def test_enrich_spreads_a_hot_series(spark, settings, mapped):
    series = ml.compact_series(mapped["series"])
    ids = [r.SeriesID for r in series.select("SeriesID").collect()]
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="16k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__shuffle__partitions="8",
    )
    # A third of the points from several tasks belong to one series.
    one = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % len(ids)).cast("int")
    points = spark.range(0, 60_000, 1, 8).select(
        F.get(F.array(*map(F.lit, ids)), one).alias("SeriesID"), F.col("id").alias("TimeUnixNano")
    )
    joined = ml.enrich(points, series)
    plan = final_plan(joined)
    # The join was split where it was hot, and nowhere was the catalogue repeated for it.
    assert "SortMergeJoin(skew=true)" in plan and "_salt" not in plan
    assert joined.count() == 60_000


def test_small_catalogue_is_broadcast_for_the_semi_join(mapped):
    joined = ml.points_where(mapped["gauge"], mapped["series"], F.col("MetricName") == "m")
    assert "BroadcastHashJoin" in final_plan(joined)
    assert joined.count() == 300


def test_known_series_are_dropped_before_any_sort(spark, settings, mapped):
    settings(spark__sql__adaptive__enabled="false")
    plan = ml.new_series(mapped["series"], mapped["series"])._jdf.queryExecution().executedPlan()
    lines = plan.toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    # All sorting of wide rows for the compaction stands above the join with the new IDs.
    assert all("max_by" not in line and "ResourceAttributes" not in line for line in lines[join:] if "Sort" in line)


def test_enrich_with_unmerged_versions_does_not_fan_out(mapped):
    doubled = mapped["series"].unionAll(mapped["series"])
    assert ml.enrich(mapped["gauge"], doubled).count() == 300


def test_orphans(mapped):
    points, series = mapped["gauge"], mapped["series"]
    assert ml.orphans(points, series).count() == 0
    without = series.filter(F.col("Attributes")["k"] != "hot")
    assert ml.orphans(points, without).count() == 100


def test_counts(mapped):
    points, series = mapped["gauge"], ml.compact_series(mapped["series"])
    name = F.col("MetricName") == "m"
    assert ml.count_series(series, name).first()[0] == 41
    assert ml.count_points(points, series, name).first()[0] == 300
    assert ml.count_points(points, series, F.lit(False)).first()[0] == 0
    assert ml.count_all(points).first()[0] == 300
    plan = ml.count_points(points, series, name)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [SeriesID")
    assert [tuple(r) for r in ml.processed_by_type(mapped_points(mapped)).collect()] == [("Gauge", 300)]


def mapped_points(mapped):
    return {t: f for t, f in mapped.items() if t not in ("series", "rejects")}


def test_series_over_time_is_ordered(mapped):
    points = mapped["gauge"]
    hot = ml.where_attribute(mapped["series"], "point", "k", "hot").first().SeriesID
    rows = ml.series_over_time(points, hot, T0 + 10, T0 + 19).collect()
    assert [r.TimeUnixNano for r in rows] == list(range(T0 + 10, T0 + 20))
    assert ml.where_series(points, [hot]).count() == 100


def test_service_and_key_filters(mapped):
    series = mapped["series"]
    assert ml.where_service(series, "svc-a").count() == 300
    assert ml.where_service(series, "other").count() == 0
    assert ml.where_attribute(series, "resource", "host.name").count() == 300
    assert ml.where_attribute(series, "scope", "host.name").count() == 0
    assert ml.where_attribute(series, "resource", "host.name", "h2").count() == 0


def test_attribute_index_rows(mapped):
    index = ml.attribute_index(ml.compact_series(mapped["series"]))
    per_scope = {r.scope: r["count"] for r in index.groupBy("scope").count().collect()}
    assert per_scope == {"resource": 82, "point": 41}


def test_rows_that_repeat_are_grouped_without_a_sort(mapped):
    rows = mapped["series"]  # one of each point
    once = distinct_rows(rows)
    plan = once._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert once.columns == rows.columns and once.count() == 41
    assert sorted(map(repr, once.collect())) == sorted(set(map(repr, rows.collect())))
