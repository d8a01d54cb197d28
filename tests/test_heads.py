"""Series and rejects straight from requests, the files of a type, and sizes of tasks."""

import datetime as dt

import pyarrow.parquet as pq
import pytest

import metricloom as ml
from metricloom.operators.catalogue import distinct_rows
from metricloom.operators.mapping import map_rejects, map_series, rejects_of_requests, series_of_requests
from metricloom.plans import ingest
from metricloom.session import INPUT_SPLITS, input_splits
from metricloom.sources import requests as requests_module
from metricloom.sources.requests import read_heads
from tests.builders import T0, gauge, kv, number, request, total

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TYPES = ("gauge", "sum", "summary")


def odd_requests():
    listed = {"arrayValue": {"values": [{"intValue": "1"}]}}
    labels = [
        (), [("k", 1)], [("k", "1")], [("b", 2.5), ("a", True)], [("a", True), ("b", 2.5)],
        [("k", "x"), ("k", 1)], [("", "none"), ("k", 1)], [("l", listed)], [("z", -0.0)], [("z", 0.0)],
    ]
    points = [number(1.0, T0 + i, own) for i, own in enumerate(labels)]
    bare = {"name": "bare", "gauge": {"dataPoints": [{"timeUnixNano": str(T0), "asDouble": 1.0}]}}
    bad = [number(1.0, 0), number(float("nan")), number(2, T0, [("k", 1)])]
    quantiles = {"dataPoints": [{"timeUnixNano": str(T0), "count": "1", "sum": 1.5}, {"timeUnixNano": "0"}]}
    both = {**gauge("both", number(1.0)), "sum": total("both", number(2))["sum"]}
    return [
        request(gauge("m", *points, *bad), total("m", *points), {"name": "s", "summary": quantiles}, both),
        request(gauge("m", *points), bare, {"name": "empty"}, gauge("", number(1.0), number(2.0))),
        request(gauge("m", *points), resource=[("b", 1), ("a", "2"), ("service.name", 3)], scope="other"),
        request(gauge("m", *points), resource=[("a", "2"), ("service.name", 3), ("b", 1)], scope="other"),
        {"resourceMetrics": [{"scopeMetrics": [{"metrics": [gauge("m", number(1.0)), {"gauge": {"dataPoints": []}}]}]}]},
        {"resourceMetrics": [{"resource": {"attributes": [{"key": "k"}, kv("n", 1)]}, "scopeMetrics": []}]},
        {},
    ]


def texts(rows):
    return sorted(map(repr, rows.collect()))


def test_series_and_rejects_are_those_of_the_points(spark, requests_of, tmp_path):
    path = str(tmp_path / "landed")
    # Times and values that JSON has no name for come as text.
    ml.land_requests(requests_of(*odd_requests()), path)
    flat = ml.flatten_metrics(ml.read_requests(spark, path, "parquet"))
    series = series_of_requests({t: read_heads(spark, path, (t,)) for t in TYPES}, NOW)
    expected = distinct_rows(map_series(flat, NOW))
    assert series.columns == expected.columns
    assert texts(distinct_rows(series)) == texts(expected)
    rejects = rejects_of_requests(
        {t: read_heads(spark, path, (t,), False) for t in TYPES}, read_heads(spark, path, (), False)
    )
    assert texts(rejects) == texts(map_rejects(flat)) and rejects.count() >= 4
    # One row per different labels reaches the shuffle, before any map is made.
    plan = series._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.rindex("HashAggregate") > plan.index("map_from_arrays") and "SortAggregate" not in plan


@pytest.mark.parametrize("folder", ["plain", "with space", "odd[1]"])
def test_a_type_is_read_from_the_files_that_hold_it(spark, requests_of, tmp_path, monkeypatch, folder):
    path, base = str(tmp_path / folder), str(tmp_path / "s")
    both = requests_of(request(gauge("g", number(1.0))), request(total("t", number(2), number(3))))
    for metric in ("g", "t"):
        one = both.filter(f"resourceMetrics[0].scopeMetrics[0].metrics[0].name = '{metric}'").coalesce(1)
        ml.land_requests(one, path, mode="append")
    asked = {}

    def noted(spark, path, format, tables=(), presence=False):
        if len(tables) == 1:
            asked[tables[0]] = path
        return requests_module.read_requests(spark, path, format, **({"presence": True} if presence else {"tables": tables}))

    monkeypatch.setattr(ingest, "read_requests", noted)
    where = path.replace("[", "\\[").replace("]", "\\]")
    ingest.ingest_files(spark, where, base, 0, NOW)
    assert ml.scan_points(spark, base, "gauge").count() == 1 and ml.scan_points(spark, base, "sum").count() == 2
    assert ml.scan_series(spark, base).count() == 2
    if "[" in folder:
        assert asked == {"gauge": where, "sum": where}
    else:
        assert len(asked["gauge"]) == len(asked["sum"]) == 1 and asked["gauge"] != asked["sum"]


def test_a_pass_is_divided_within_landed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(requests_module, "ROW_GROUP_BYTES", 4096)
    path = str(tmp_path / "landed")
    rows = spark.range(5000).selectExpr("array(named_struct('schemaUrl', uuid())) as resourceMetrics")
    ml.land_requests(rows.coalesce(1), path)
    file = next((tmp_path / "landed").glob("*.parquet"))
    assert pq.ParquetFile(file).num_row_groups > 5


def test_sizes_of_tasks_are_lent_and_those_of_the_session_stay(spark):
    whole, cost = INPUT_SPLITS
    before = spark.conf.get(whole)
    with input_splits(spark):
        assert spark.conf.get(whole) == INPUT_SPLITS[whole]
    assert spark.conf.get(whole) == before and whole not in spark.conf.getAll
    spark.conf.set(whole, "64m")
    try:
        with input_splits(spark):
            assert spark.conf.get(whole) == "64m" and spark.conf.get(cost) == INPUT_SPLITS[cost]
        assert spark.conf.get(whole) == "64m"
    finally:
        spark.conf.unset(whole)
