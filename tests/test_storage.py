"""Tables on disk: layout, pushdown, snapshots, merges, replay."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

import metricloom as ml
from metricloom.operators.mapping import map_requests
from metricloom.plans.ingest import ingest_files, write_batch
from metricloom.schema import POINT_TABLES
from metricloom.session import scratch_path
from metricloom.sources import files, manifest
from metricloom.sources import tables as tables_module
from metricloom.sources.manifest import live, load
from tests.builders import T0, gauge, number, request

DAY = 86_400_000_000_000
NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "store")
    ml.create_tables(spark, path)
    return path


@pytest.fixture
def tables(requests_of):
    points = [
        number(float(i), T0 + (i % 3) * DAY + i, attributes=[("k", i % 5)]) for i in range(60)
    ]
    mapped = map_requests(requests_of(request(gauge("m", *points))), NOW)
    return mapped


def test_tables_start_empty_and_creation_is_idempotent(spark, base, tables):
    assert all(ml.scan_points(spark, base, t).count() == 0 for t in POINT_TABLES)
    assert ml.scan_series(spark, base).count() == 0
    ml.write_points(tables["gauge"], "gauge", base, 0)
    ml.create_tables(spark, base)
    assert ml.scan_points(spark, base, "gauge").count() == 60


def test_days_are_folders_and_files_are_sorted(spark, base, tables):
    ml.write_points(tables["gauge"], "gauge", base, 0)
    stored = ml.scan_points(spark, base, "gauge")
    rows = stored.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"),
        "TimeDate", "SeriesID", "TimeUnixNano",
    ).collect()
    files = {}
    for r in rows:
        assert f"TimeDate={r.TimeDate}" in r.file
        files.setdefault(r.file, []).append((r.i, (r.SeriesID, r.TimeUnixNano)))
    assert len({r.TimeDate for r in rows}) == 3
    for entries in files.values():
        keys = [k for _, k in sorted(entries)]
        assert keys == sorted(keys)


def test_time_range_prunes_days_and_series_filter_is_pushed(spark, base, tables):
    ml.write_points(tables["gauge"], "gauge", base, 0)
    points = ml.scan_points(spark, base, "gauge")
    found = ml.time_range(points, T0 + DAY, T0 + DAY + 100)
    scan = next(line for line in plan_of(found).splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(TimeDate" in scan
    assert "GreaterThanOrEqual(TimeUnixNano" in scan
    assert found.count() == 20
    one = ml.where_series(points.select("SeriesID", "Value"), 5)
    scan = next(line for line in plan_of(one).splitlines() if "FileScan" in line)
    assert "EqualTo(SeriesID,5)" in scan and "ReadSchema: struct<SeriesID:bigint,Value:double>" in scan


def test_empty_write_makes_no_rows(spark, base, tables):
    ml.write_points(tables["gauge"].filter("false"), "gauge", base, 0)
    assert ml.scan_points(spark, base, "gauge").count() == 0


def test_replayed_batch_replaces_its_rows(spark, base, tables):
    for _ in range(2):
        ml.write_points(tables["gauge"], "gauge", base, 3)
        ml.write_series(tables["series"], base, 3)
    assert ml.scan_points(spark, base, "gauge").count() == 60
    assert ml.scan_series(spark, base).count() == 60


def folders(frame):
    """Folders of writes that a frame reads."""
    return {re.search(r"write=(\d+)", f).group(1) for f in frame.inputFiles()}


def test_repeated_writes_of_a_series_compact_to_one_row(spark, base, requests_of):
    row = map_requests(requests_of(request(gauge("mt", number(1.0)))), NOW)["series"]
    for batch_id in range(4):
        ml.write_series(row, base, batch_id)
    assert ml.scan_series(spark, base).count() == 4
    ml.optimize_series(spark, base)
    assert ml.scan_series(spark, base).count() == 1
    ml.write_series(row, base, 4)
    assert ml.scan_series(spark, base).count() == 2
    ml.optimize_series(spark, base)
    version = load(spark, base)["version"]
    ml.optimize_series(spark, base)
    assert ml.scan_series(spark, base).count() == 1 and load(spark, base)["version"] == version


def third(tables, k):
    return tables["gauge"].filter(F.col("Value") % 3 == k)


def test_a_batch_below_a_merge_is_read_and_stays(spark, base, tables):
    for batch_id in (4, 9):
        ml.write_points(third(tables, batch_id % 3), "gauge", base, batch_id)
    assert ml.scan_points(spark, base, "gauge").count() == 40 - 20 * (4 % 3 == 9 % 3)
    ml.merge_points(spark, base, "gauge")
    ml.write_points(third(tables, 2), "gauge", base, 1)  # late, or of a writer that began later
    for _ in range(2):
        assert ml.scan_points(spark, base, "gauge").select("Value").distinct().count() == 60
        removed = ml.remove_superseded(spark, base)
    assert removed == [] and ml.scan_points(spark, base, "gauge").count() == 60
    ml.merge_points(spark, base, "gauge")  # one write since the last merge: nothing to do
    ml.write_points(third(tables, 2), "gauge", base, 2)
    ml.merge_points(spark, base, "gauge")
    assert [w["holds"] for w in live(load(spark, base), "gauge")] == [
        {"direct": [[4, 4], [9, 9]]}, {"direct": [[1, 2]]},
    ]
    assert ml.scan_points(spark, base, "gauge").count() == 80


def test_merged_points_are_read_once_in_one_scan(spark, base, tables):
    for batch_id in range(3):
        ml.write_points(third(tables, batch_id), "gauge", base, batch_id)
    ml.merge_points(spark, base, "gauge")
    points = ml.scan_points(spark, base, "gauge")
    assert points.count() == 60 and points.select("Value").distinct().count() == 60
    scans = [x for x in plan_of(ml.time_range(points, T0, T0 + 5)).splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "TimeDate" in scans[0].split("PartitionFilters: [")[1].split("]")[0]


def test_only_live_folders_are_listed_and_others_can_go(spark, base, tables):
    for batch_id in range(2):
        ml.write_points(third(tables, batch_id), "gauge", base, batch_id)
        ml.write_series(ml.distinct_series(tables["series"]), base, batch_id)
    old = folders(ml.scan_points(spark, base, "gauge")), folders(ml.scan_series(spark, base))
    ml.merge_points(spark, base, "gauge")
    ml.optimize_series(spark, base)
    ml.write_points(third(tables, 2), "gauge", base, 2)
    points, series = ml.scan_points(spark, base, "gauge"), ml.scan_series(spark, base)
    assert len(folders(points)) == 2 and len(folders(series)) == 1
    before = points.count(), series.count()
    removed = ml.remove_superseded(spark, base)
    assert {r.removeprefix(base) for r in removed} == {
        *(f"/points/write={n}/table=gauge" for n in old[0]), *(f"/series/write={n}" for n in old[1])
    }
    assert (ml.scan_points(spark, base, "gauge").count(), ml.scan_series(spark, base).count()) == before
    assert ml.remove_superseded(spark, base) == []


def test_a_merged_batch_is_not_written_again(spark, base, tables):
    for batch_id in range(2):
        ml.write_points(third(tables, batch_id), "gauge", base, batch_id)
    ml.merge_points(spark, base, "gauge")
    with pytest.raises(manifest.Replaced, match="part of merged gauge"):
        ml.write_points(third(tables, 0), "gauge", base, 0)
    assert ml.scan_points(spark, base, "gauge").count() == 40


def test_a_merge_that_comes_second_changes_nothing(spark, base, tables, monkeypatch):
    for batch_id in range(2):
        ml.write_points(third(tables, batch_id), "gauge", base, batch_id)
    stale = load(spark, base)
    ml.merge_points(spark, base, "gauge")
    monkeypatch.setattr("metricloom.sources.tables.load", lambda *_: stale)
    with pytest.raises(manifest.Replaced, match="taken over"):
        ml.merge_points(spark, base, "gauge")
    monkeypatch.undo()
    assert ml.scan_points(spark, base, "gauge").count() == 40


def test_attribute_index_gives_the_same_series(spark, base, tables):
    series = ml.compact_series(tables["series"])
    ml.write_series(series, base, 0)
    ml.write_attribute_index(spark, base)
    index = ml.scan_attribute_index(spark, base)
    found = ml.indexed_series(index, "point", "k", "3")
    scan = next(line for line in plan_of(found).splitlines() if "FileScan" in line)
    assert "EqualTo(key,k)" in scan and "EqualTo(value,3)" in scan and "scope" in scan
    direct = ml.where_attribute(series, "point", "k", "3").select("SeriesID")
    assert found.collect() == direct.collect()
    points = tables["gauge"]
    assert ml.points_of(points, found).count() == 12
    assert ml.points_where(points, series, ml.attribute_predicate("point", "k", "3")).count() == 12


def test_index_is_never_behind_the_catalogue(spark, base, tables):
    series = ml.compact_series(tables["series"])
    first = ml.attribute_predicate("point", "k", "3")

    def by_index(value, scope="point", key="k"):
        return ml.indexed_series(ml.scan_attribute_index(spark, base), scope, key, value).count()

    def parts():
        return len(live(load(spark, base), "attribute_index"))

    assert by_index("3") == 0
    ml.write_series(series.filter(~first), base, 0)
    ml.write_attribute_index(spark, base)
    assert (by_index("3"), by_index("1"), parts()) == (0, 1, 1)
    ml.write_series(series.filter(first), base, 1)
    assert (by_index("3"), by_index("1")) == (1, 1)
    # A later version of a series replaces what the index says of its scope.
    moved = series.filter(first).withColumn("ScopeAttributes", F.create_map(F.lit("team"), F.lit("t9")))
    ml.write_series(moved, base, 2)
    assert by_index("t9", "scope", "team") == 1
    for _ in range(2):
        ml.write_attribute_index(spark, base)
    assert (by_index("3"), by_index("1"), by_index("t9", "scope", "team"), parts()) == (1, 1, 1, 2)
    ml.write_series(moved.withColumn("ScopeAttributes", F.create_map(F.lit("team"), F.lit("t8"))), base, 3)
    for step in (ml.write_attribute_index, ml.merge_attribute_index, ml.optimize_series):
        step(spark, base)
        assert (by_index("t9", "scope", "team"), by_index("t8", "scope", "team")) == (0, 1)
        assert (by_index("3"), by_index("1")) == (1, 1)
    assert parts() == 1 and ml.scan_series(spark, base).count() == 5
    # The catalogue rewritten to one row per series is covered as its writes were.
    ml.write_attribute_index(spark, base)
    assert parts() == 1


def test_an_index_write_reads_only_what_came_since(spark, base, tables, monkeypatch):
    series = ml.compact_series(tables["series"])
    asked = []
    read = tables_module.read_writes
    monkeypatch.setattr(
        tables_module, "read_writes", lambda *a, **k: asked.append((a[1].removeprefix(base), a[2])) or read(*a, **k)
    )
    for batch_id in range(3):
        own = F.expr(f"cast(Attributes['k'] as int) % 3 = {batch_id}")
        ml.write_series(series.filter(own), base, batch_id)
        asked.clear()
        ml.write_attribute_index(spark, base)
        assert asked == [("/series", [live(load(spark, base), "series")[-1]["id"]])]
    index = ml.scan_attribute_index(spark, base)
    assert index.count() == index.distinct().count() == ml.attribute_index(series).count()
    scan = [x for x in plan_of(ml.indexed_series(index, "point", "k", "3")).splitlines() if "FileScan" in x]
    assert any("EqualTo(key,k)" in x and "EqualTo(value,3)" in x for x in scan)


def test_ingest_files_and_ledger(spark, requests_of, tmp_path):
    base, landed = str(tmp_path / "s"), str(tmp_path / "landed")
    ml.land_requests(
        requests_of(request(gauge("m", number(1.0), number(2.0, 0)), gauge("", number(1.0)))), landed
    )
    ingest_files(spark, landed, base, 0, NOW)
    ingest_files(spark, landed, base, 1, NOW)
    ledger = ml.scan_rows(spark, base, "ledger")
    sizes = {(r.batch_id, r.table): r["rows"] for r in ml.batch_sizes(ledger).collect()}
    assert sizes[0, "series"] == 1 and (1, "series") not in sizes and (0, "sum") not in sizes
    assert sizes[0, "gauge"] == sizes[1, "gauge"] == 1
    assert sizes[0, "rejects"] == 2
    reasons = ml.skipped_by_reason(ml.scan_rows(spark, base, "rejects").filter("batch_id = 0"))
    assert {tuple(r) for r in reasons.collect()} == {("zero_timestamp", 1), ("empty_metric_name", 1)}
    stats = {r.table: (r.writes, r.failures) for r in ml.write_stats(ledger).collect()}
    assert stats["gauge"] == (2, 0)


def test_failed_write_is_recorded_and_stops_the_batch(spark, base, requests_of, monkeypatch):
    from metricloom.plans import ingest

    flat = ml.flatten_metrics(requests_of(request(gauge("m", number(1.0)))))

    def broken(*_):
        raise OSError("disk gone")

    monkeypatch.setattr(ingest, "put_points", broken)
    with pytest.raises(RuntimeError, match="write of gauge failed"):
        write_batch(spark, lambda _: flat, base, 0, NOW, ["gauge"])
    assert ml.scan_series(spark, base).count() == 0  # all of a batch is visible, or nothing
    assert files.names(spark, f"{base}/series") == []
    stats = {r.table: (r.writes, r.failures) for r in ml.write_stats(ml.scan_rows(spark, base, "ledger")).collect()}
    assert stats == {"series": (1, 1), "gauge": (1, 1)}
    monkeypatch.undo()
    write_batch(spark, lambda _: flat, base, 0, NOW, ["gauge"])
    assert ml.scan_series(spark, base).count() == ml.scan_points(spark, base, "gauge").count() == 1


def test_per_type_read_leaves_other_payloads_in_the_file(spark, requests_of, tmp_path):
    landed = str(tmp_path / "landed")
    ml.land_requests(requests_of(request(gauge("m", number(1.0)))), landed)
    points = ml.map_gauge(ml.flatten_metrics(ml.read_requests(spark, landed, "parquet", ["gauge"])))
    schema = points._jdf.queryExecution().optimizedPlan().collectLeaves().head().schema().simpleString()
    assert "quantileValues" not in schema and "bucketCounts" not in schema
    assert points.count() == 1


def test_bloom_filters_are_in_the_files(spark, base, tables):
    import pyarrow.parquet as pq

    names = F.concat(F.lit("metric-"), F.col("SeriesID").cast("string"))
    many = ml.distinct_series(tables["series"]).crossJoin(spark.range(2000)).select(
        *[F.xxhash64("SeriesID", "id").alias(c) if c == "SeriesID" else c for c in tables["series"].columns]
    )
    ml.write_series(many.withColumn("MetricName", names), base, 0)
    stored = ml.scan_series(spark, base)
    one = stored.select("MetricName").first().MetricName
    found = ml.where_metric(stored, one)
    scan = next(line for line in plan_of(found).splitlines() if "FileScan" in line)
    assert "EqualTo(MetricName," in scan and found.count() >= 1
    # A footer names the place of a column's bloom filter in its column metadata.
    file = stored.inputFiles()[0].removeprefix("file:").replace("///", "/")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in columns}
    reader.close()
    assert offsets["MetricName"] > 0 and pq.ParquetFile(file).metadata.num_rows > 0
    assert offsets["MetricDescription"] < 0


def rows_read(frame):
    """Rows that the scan of a frame gave on, once it has run: without row groups that it skipped."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_skip_row_groups(spark, base, tables):
    spark.conf.set("parquet.block.size", "65536")
    names = F.concat(F.lit("metric-"), F.xxhash64("SeriesID").cast("string"))
    many = ml.distinct_series(tables["series"]).crossJoin(spark.range(4000)).select(
        *[F.xxhash64("SeriesID", "id").alias(c) if c == "SeriesID" else c for c in tables["series"].columns]
    ).withColumn("MetricName", names)
    points = tables["gauge"].limit(1).crossJoin(spark.range(30000)).select(
        *[F.xxhash64("id").alias(c) if c == "SeriesID" else c for c in tables["gauge"].columns]
    )
    for half in (0, 1):
        ml.write_series(many.filter(F.col("SeriesID") % 2 == half), base, half)
        ml.write_points(points.filter(F.pmod("SeriesID", F.lit(2)) == half), "gauge", base, half)
    ml.merge_points(spark, base, "gauge")
    spark.conf.unset("parquet.block.size")
    # Names are in no order, so that the ends of a row group tell nothing: its bloom filter does.
    series = ml.scan_series(spark, base).select("MetricName")
    total, known = series.count(), series.first().MetricName
    one, none = (ml.where_metric(series, name) for name in (known, known + "0"))
    assert 0 < rows_read(one) < total / 2 and one.count() == 1
    assert rows_read(none) < total / 4 and none.count() == 0
    # The points of a merge are in the order of their series, and have filters of them too.
    stored = ml.scan_points(spark, base, "gauge").select("SeriesID")
    some = stored.first().SeriesID
    found, absent = (ml.where_series(stored, i) for i in (some, some + 1))
    assert stored.count() == 30000 and 0 < rows_read(found) < 15000 and found.count() == 1
    assert rows_read(absent) == 0


def test_poison_counts_and_broken_lines_stop_nothing(spark, tmp_path):
    point = {"timeUnixNano": str(T0), "bucketCounts": ["1"]}
    metric = {"name": "h", "histogram": {"dataPoints": [point | {"count": c} for c in ("1", str(2**63), "2")]}}
    (tmp_path / "r.json").write_text(
        json.dumps(request(metric)) + '\n{"resourceMetrics": [oops\n' + json.dumps(request(gauge("m", number(1.0))))
    )
    landed, base = f"{tmp_path}/landed", f"{tmp_path}/store"
    ml.land_requests(ml.read_requests(spark, str(tmp_path / "r.json")), landed)
    ingest_files(spark, landed, base, 0, NOW)
    counts = ml.scan_points(spark, base, "histogram").select("Count").collect()
    assert sorted(r.Count for r in counts) == [-(2**63), 1, 2]
    assert ml.scan_points(spark, base, "gauge").count() == 1
    rejects = ml.scan_rows(spark, base, "rejects").collect()
    assert [r.reason for r in rejects] == ["unreadable_request"]
    with pytest.raises(ValueError, match="land"):
        ingest_files(spark, str(tmp_path / "r.json"), base, 1, NOW, "json")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda name, default: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert scratch_path(session("local[4]"), "x")
    assert scratch_path(session("yarn", "s3://b/c"), "x").startswith("s3://b/c/metricloom/x-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="shared folder"):
            scratch_path(session(master), "x")
