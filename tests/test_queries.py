"""Every registered query against its SQL answer at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    if not Path(SF_DIR).exists():
        pytest.skip("no test data")
    database = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return database


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, connection, key):
    state, _, _, detail = compare(
        spark, connection, SF_DIR, key, QUERIES[key], ORACLE[key]
    )
    assert state == "match", detail


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and {"MetricName", "ServiceName", "Value"} <= set(rows.columns)


def test_a_list_of_too_many_series_is_refused(spark, monkeypatch):
    from workload import queries

    monkeypatch.setattr(queries, "MOST_IDS", 0)
    with pytest.raises(ValueError, match="more than 0 series"):
        queries._series_ids(spark, SF_DIR)


def test_series_keys_are_grouped_without_sorting_points(spark):
    plan = QUERIES["d2_series_id"](spark, SF_DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    lowest = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in lowest and "SortAggregate" not in lowest


def test_landed_requests_of_a_type_have_its_payload_alone(spark, tmp_path):
    import metricloom as ml
    from workload.store import store_requests

    dense, sparse = (store_requests(spark, SF_DIR, 0, sparse) for sparse in (False, True))
    for whole, few in zip(dense, sparse, strict=True):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        ml.land_requests(few, path, mode="append")
        assert sum(f"{arm}:struct" in few.schema.simpleString() for arm in ("gauge", "sum", "histogram", "exponentialHistogram", "summary")) == 1
        both = [ml.read_requests(spark, path, "parquet").drop("unreadable"), whole]
        assert sorted(map(repr, both[0].collect())) == sorted(map(repr, both[1].collect()))
