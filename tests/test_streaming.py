"""Streaming ingest equals batch ingest, also after a replay."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import metricloom as ml
from metricloom.operators.flatten import nameless_metrics
from metricloom.plans import ingest
from metricloom.plans.ingest import units_of
from metricloom.schema import POINT_TABLES
from metricloom.sources import files
from metricloom.sources.manifest import Fenced, commit, hold, load
from metricloom.sources.tables import put_bounded_points, recent_series
from metricloom.streaming.dedup import store_new_batch
from metricloom.streaming import ingest as streams
from metricloom.streaming.ingest import ingest_micro_batch, ingest_named_files, names_files, stream_identity
from tests.builders import T0, gauge, number, request, total

MONTH = 30 * 86_400_000_000_000


@pytest.fixture
def folder(tmp_path):
    """Six request files; the later ones repeat series and bring month-old points."""
    path = tmp_path / "requests"
    path.mkdir()
    for i in range(6):
        time = T0 - (MONTH if i == 5 else 0) + i
        lines = [
            request(
                gauge("cpu", number(float(j), time + j, attributes=[("cpu", j % 2)])),
                total("req", number(j, time + j)),
            )
            for j in range(5)
        ]
        (path / f"{i}.json").write_text("\n".join(json.dumps(r) for r in lines))
    return str(path)


def state(spark, base):
    points = {t: ml.scan_points(spark, base, t).count() for t in POINT_TABLES}
    return points, ml.scan_series(spark, base).count()


EXPECTED = (dict.fromkeys(POINT_TABLES, 0) | {"gauge": 30, "sum": 30}, 3)


def test_drain_in_capped_batches(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    ml.drain(ml.stream_requests(spark, folder, max_files=2), base, f"{base}/checkpoint")
    assert state(spark, base) == EXPECTED
    series = ml.scan_series(spark, base)
    assert all(ml.orphans(ml.scan_points(spark, base, t), series).count() == 0 for t in ("gauge", "sum"))
    ledger = ml.scan_rows(spark, base, "ledger")
    assert ledger.select("batch_id").distinct().count() == 3
    assert {r.table for r in ledger.select("table").distinct().collect()} == {
        "series", "gauge", "sum",
    }
    # A second drain finds nothing new.
    ml.drain(ml.stream_requests(spark, folder, max_files=2), base, f"{base}/checkpoint")
    assert state(spark, base) == EXPECTED


def test_replay_of_a_micro_batch(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    ml.create_tables(spark, base)
    requests = ml.read_requests(spark, folder)
    for batch_id in (0, 1, 1):
        ingest_micro_batch(requests, base, batch_id)
        if batch_id == 1:
            rows = ml.scan_series(spark, base).collect()
    points, series = state(spark, base)
    assert points["gauge"] == 60 and series == 3
    # The replay has the stamps of the first attempt.
    assert sorted(map(repr, ml.scan_series(spark, base).collect())) == sorted(map(repr, rows))


def test_replay_keeps_the_stamps_of_new_series(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    ml.create_tables(spark, base)
    requests = ml.read_requests(spark, folder)
    seen = []
    for _ in range(2):
        ingest_micro_batch(requests, base, 5)
        seen.append(sorted((r.SeriesID, r.FirstSeen, r.LastSeen) for r in ml.scan_series(spark, base).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 3


def test_empty_micro_batch_makes_no_file(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    ml.create_tables(spark, base)
    ingest_micro_batch(ml.read_requests(spark, folder).filter("false"), base, 0)
    assert [f for f in (tmp_path / "store").rglob("*") if f.is_file()] == []


@pytest.mark.parametrize("most", [5, 16, 1000])
def test_units_hold_all_points_in_order_and_no_more_than_the_bound(spark, requests_of, most):
    sizes = [0, 1, 23, 0, 7, 8, 9, 1, 1, 40]
    metrics = [gauge(f"m{k}", *[number(1.0, T0 + k * 1000 + j) for j in range(n)]) for k, n in enumerate(sizes)]
    metrics += [gauge("", *[number(1.0, T0 + j) for j in range(50)]), {"name": "bare"}, total("s", number(1, T0))]
    flat = ml.flatten_metrics(requests_of(request(*metrics[:5]), request(*metrics[5:]))).repartition(3).persist()
    units = units_of(flat, most)
    stored, nameless = [], 0
    for unit in units:
        rows = [r for t in ("gauge", "sum") for r in ml.map_points(unit, t).select("MetricName", "TimeUnixNano").collect()]
        assert len(rows) <= most
        stored += rows
        nameless += nameless_metrics(unit).count()
    whole = [r for t in ("gauge", "sum") for r in ml.map_points(flat, t).select("MetricName", "TimeUnixNano").collect()]
    assert sorted(stored) == sorted(whole) and len(whole) == 91 and nameless == 1
    assert len(units) >= 91 / most


def test_writes_of_a_batch_are_bounded_and_committed_together(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    ml.drain(ml.stream_requests(spark, folder), base, f"{base}/checkpoint", max_points=8)
    assert state(spark, base) == EXPECTED
    writes = [w for w in load(spark, base)["writes"] if set(w["tables"]) & set(POINT_TABLES)]
    assert all(sum(w["tables"].values()) <= 8 for w in writes) and len(writes) >= 8
    assert load(spark, base)["version"] == 3  # taken, one batch, let go


def test_streams_with_own_checkpoints_share_a_base(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    other = tmp_path / "other"
    other.mkdir()
    (other / "r.json").write_text(json.dumps(request(gauge("cpu", *[number(1.0, T0 + 99 + j) for j in range(7)]))))
    ml.drain(ml.stream_requests(spark, folder, max_files=2), base, f"{base}/one")
    ml.drain(ml.stream_requests(spark, str(other)), base, f"{base}/two")
    points, series = state(spark, base)
    assert points["gauge"] == 37 and points["sum"] == 30 and series == 4
    for checkpoint in ("one", "two"):  # started again, each goes on where it was
        ml.drain(ml.stream_requests(spark, folder if checkpoint == "one" else str(other)), base, f"{base}/{checkpoint}")
    assert state(spark, base) == (points, series)


def test_streams_at_the_same_time(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    running = [
        ml.start_ingest(ml.stream_requests(spark, folder, max_files=3), base, f"{base}/c{k}", "1 second")
        for k in range(2)
    ]
    try:
        for query in running:
            query.processAllAvailable()
    finally:
        for query in running:
            query.stop()
    points, _ = state(spark, base)
    assert points["gauge"] == points["sum"] == 60
    assert ml.compact_series(ml.scan_series(spark, base)).count() == 3


def test_a_second_application_is_refused_until_it_takes_over(spark, folder, tmp_path):
    base, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    ml.create_tables(spark, base)
    writer = stream_identity(spark, checkpoint)
    assert stream_identity(spark, checkpoint) == writer
    commit(spark, base, lambda s: hold(s, writer, "application-1"))
    with pytest.raises(Fenced, match="application-1"):
        ml.drain(ml.stream_requests(spark, folder), base, checkpoint)
    ml.drain(ml.stream_requests(spark, folder), base, checkpoint, take_over=True)
    assert state(spark, base) == EXPECTED
    # The old one wakes up: while the new one holds the name, its batch is refused and leaves nothing.
    commit(spark, base, lambda s: hold(s, writer, "application-2"))
    with pytest.raises(Fenced):
        ingest_micro_batch(ml.read_requests(spark, folder), base, 7, writer=writer, owner="application-1")
    assert state(spark, base) == EXPECTED
    assert len(files.names(spark, f"{base}/points")) == 1


def test_continuous_ingest_and_stop(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    running = ml.start_ingest(
        ml.stream_requests(spark, folder, max_bytes=2000), base, f"{base}/checkpoint", "1 second"
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert state(spark, base) == EXPECTED


def test_new_series_are_stored_once_within_the_horizon(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    hour = dt.timedelta(hours=1)

    def stream():
        points = ml.map_points(ml.flatten_metrics(ml.stream_requests(spark, folder, max_files=2)), "gauge")
        return ml.series_rows(points, F.current_timestamp())

    for checkpoint in ("one", "one", "two"):  # again, and another stream with the same series
        ml.store_new_series(stream(), base, f"{base}/{checkpoint}", hour)
        assert ml.scan_series(spark, base).count() == 2
    rows = ml.scan_series(spark, base).drop("write")
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=2)
    store_new_batch(rows, base, 0, hour, "w")  # known
    store_new_batch(rows, base, 1, hour, "w", now=later)  # known, but longer ago than the horizon
    store_new_batch(rows, base, 1, hour, "w", now=later)  # stored already
    assert ml.scan_series(spark, base).count() == 4 and ml.compact_series(ml.scan_series(spark, base)).count() == 2


def test_new_series_of_a_batch_combine_before_the_shuffle(spark, folder, tmp_path):
    base = str(tmp_path / "store")
    ml.create_tables(spark, base)
    points = ml.map_points(ml.flatten_metrics(ml.read_requests(spark, folder)), "gauge")
    series = ml.series_rows(points, F.current_timestamp())
    recent = recent_series(spark, base, dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc))
    plan = ml.new_series(series, recent)._jdf.queryExecution().toString()
    shuffled = plan.split("== Physical Plan ==")[1].splitlines()
    at = [i for i, line in enumerate(shuffled) if "Exchange hashpartitioning(SeriesID" in line]
    assert at and any("HashAggregate(keys=[SeriesID" in shuffled[i + 1] and "functions=[]" in shuffled[i + 1] for i in at)


def test_series_stream_emits_each_id_once_and_keeps_old_points(spark, folder, tmp_path):
    out = str(tmp_path / "series")
    stream = ml.stream_requests(spark, folder, max_files=2)
    points = ml.map_points(ml.flatten_metrics(stream), "gauge")
    series = ml.new_series_stream(ml.series_rows(points, F.current_timestamp()), "1 hour")
    (
        series.select("SeriesID")
        .writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows", format="parquet")
        .awaitTermination()
    )
    assert spark.read.parquet(f"{out}/rows").count() == 2


def test_bounded_writes_are_one_job_and_few_files(spark, folder, tmp_path, monkeypatch):
    base = str(tmp_path / "store")
    jobs = []
    monkeypatch.setattr(ingest, "put_bounded_points", lambda *a: jobs.append(a) or put_bounded_points(*a))
    ml.create_tables(spark, base)
    ingest_micro_batch(ml.read_requests(spark, folder), base, 0, max_points=4)
    assert state(spark, base) == EXPECTED and len(jobs) == 1
    writes = [w for w in load(spark, base)["writes"] if set(w["tables"]) & set(POINT_TABLES)]
    assert all(sum(w["tables"].values()) <= 4 for w in writes) and 15 <= len(writes) <= 19
    # Points are cut in the order of type and day: a write has one of each, or two where one ends.
    found = list((tmp_path / "store/points").rglob("*.parquet"))
    assert len(found) <= len(writes) + 4
    assert sorted(files.names(spark, f"{base}/points")) == sorted(f"write={w['id']}" for w in writes)


def test_a_failed_move_leaves_no_bounded_write(spark, folder, tmp_path, monkeypatch):
    base = str(tmp_path / "store")
    ml.create_tables(spark, base)
    moved = files.move

    def broken(spark, targets):
        moved(spark, dict(list(targets.items())[:2]))
        raise OSError("full")

    monkeypatch.setattr(files, "move", broken)
    with pytest.raises(RuntimeError, match="full"):
        ingest_micro_batch(ml.read_requests(spark, folder), base, 0, max_points=4)
    assert files.names(spark, f"{base}/points") == []


@pytest.fixture
def landed(spark, folder, tmp_path):
    """The same requests as Parquet, with names that read as patterns and one file that has no rows."""
    made, path = tmp_path / "made", tmp_path / "landed"
    path.mkdir()
    for i, name in enumerate(["0", "[1]", "{2}", "3*?", "4 %20", "5"]):
        ml.land_requests(ml.read_requests(spark, f"{folder}/{i}.json").coalesce(1), f"{made}/{i}")
        (file,) = (made / str(i)).glob("*.parquet")
        file.rename(path / f"{name}.parquet")
    ml.land_requests(ml.read_requests(spark, folder).limit(0).coalesce(1), f"{made}/none")
    (file,) = (made / "none").glob("*.parquet")
    file.rename(path / "none.parquet")
    return str(path)


@pytest.mark.parametrize(("max_files", "batches"), [(64, 1), (2, 3)])
def test_micro_batches_of_parquet_files_are_not_held(spark, folder, landed, tmp_path, monkeypatch, max_files, batches):
    def held(*args, **kwargs):
        raise AssertionError("a micro-batch of Parquet files was cached")

    base, other = str(tmp_path / "store"), str(tmp_path / "other")
    ml.drain(ml.stream_requests(spark, folder), other, f"{other}/checkpoint")
    monkeypatch.setattr(streams, "ingest_micro_batch", held)
    for _ in range(2):  # the second time there is nothing left
        ml.drain(ml.stream_requests(spark, landed, "parquet", max_files), base, f"{base}/checkpoint", max_points=8)
    assert state(spark, base)[0] == EXPECTED[0]
    writes = [w for w in load(spark, base)["writes"] if set(w["tables"]) & set(POINT_TABLES)]
    assert all(sum(w["tables"].values()) <= 8 for w in writes)
    assert batches <= ml.scan_rows(spark, base, "ledger").select("batch_id").distinct().count() <= batches + 1
    for table in ("gauge", "sum"):
        one, two = (ml.scan_points(spark, b, table) for b in (base, other))
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.select(*one.columns).collect()))
    names = [c for c in ml.scan_series(spark, base).columns if c not in ("FirstSeen", "LastSeen", "write")]
    one, two = (ml.compact_series(ml.scan_series(spark, b)).select(*names).collect() for b in (base, other))
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and len(one) == 3


def test_rejects_of_parquet_files(spark, tmp_path):
    path, base = tmp_path / "requests", str(tmp_path / "store")
    path.mkdir()
    lines = [json.dumps(request(gauge("", number(1.0, T0)), gauge("cpu", number(1.0, 0), number(2.0, T0)))), "{broken"]
    (path / "r.json").write_text("\n".join(lines))
    ml.land_requests(ml.read_requests(spark, str(path)), str(tmp_path / "landed"))
    for name, folder, format in (("json", path, "json"), ("parquet", tmp_path / "landed", "parquet")):
        ml.drain(ml.stream_requests(spark, str(folder), format), f"{base}-{name}", f"{base}-{name}/checkpoint")
    one, two = (
        sorted(map(repr, ml.scan_rows(spark, f"{base}-{n}", "rejects").drop("writer").collect())) for n in ("json", "parquet")
    )
    assert one == two and len(one) == 3
    assert state(spark, f"{base}-json") == state(spark, f"{base}-parquet")


def test_only_whole_parquet_streams_are_read_by_their_files(spark, folder, landed):
    stream = ml.stream_requests(spark, landed, "parquet")
    assert names_files(stream) and names_files(ml.stream_requests(spark, landed, "parquet", max_bytes=100))
    assert not names_files(ml.stream_requests(spark, folder))
    assert not names_files(stream.filter("unreadable is null")) and not names_files(stream.limit(3))
    reader = spark.readStream.schema(stream.schema)
    assert not names_files(reader.option("ignoreCorruptFiles", "true").parquet(landed))
    assert not names_files(spark.readStream.schema(stream.select("unreadable").schema).parquet(landed))


def test_a_filtered_parquet_stream_stores_what_it_holds(spark, landed, tmp_path):
    base = str(tmp_path / "store")
    stream = ml.stream_requests(spark, landed, "parquet").filter("unreadable is not null")
    ml.drain(stream, base, f"{base}/checkpoint")
    assert state(spark, base) == (dict.fromkeys(POINT_TABLES, 0), 0)


def test_a_replayed_batch_of_files_changes_nothing(spark, landed, tmp_path):
    base = str(tmp_path / "store")
    ml.create_tables(spark, base)
    names = ml.read_requests(spark, landed, "parquet").select("_metadata.file_path")
    for _ in range(2):
        ingest_named_files(names, base, 0, "one")
        assert state(spark, base) == EXPECTED
    ingest_named_files(names.limit(0), base, 1, "one")
    assert state(spark, base) == EXPECTED and load(spark, base)["version"] == 1
