"""One query per operator, over the whole provided tables.

out of the results, since the SQL side has no XXH64; the md5 of the canonical
key stands for them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import metricloom as ml
from metricloom.functions import attributes as attr
from metricloom.functions import common, identity, numbers, quantiles, times
from metricloom.operators.flatten import named_metrics, nameless_metrics
from metricloom.operators.mapping import identified
from metricloom.operators.validate import nameless_rejects
from metricloom.plans.ingest import ingest_files
from metricloom.schema import POINT_TABLES
from metricloom.session import scratch_path
from metricloom.sources.tables import write_rejects
from workload import shapes
from workload.store import INGEST_TIMES, landed, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANGE_START = datetime(2024, 1, 5, tzinfo=timezone.utc)
RANGE_END = datetime(2024, 1, 12, 12, tzinfo=timezone.utc)
CATALOGUE_CUT = "ts < timestamp_ntz'2024-01-16 00:00:00'"
METRIC = "events.click"
SERVICE = "svc-3"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- inputs


def _events(spark, sf_dir):
    return shapes.table(spark, sf_dir, "events")


def _flat_events(spark, sf_dir):
    return ml.flatten_metrics(shapes.gauge_requests(_events(spark, sf_dir)))


def _gauges(spark, sf_dir, condition=None):
    events = _events(spark, sf_dir)
    if condition:
        events = events.filter(condition)
    return ml.map_gauge(ml.flatten_metrics(shapes.gauge_requests(events)))


def _series(spark, sf_dir, condition=None):
    return ml.series_rows(_gauges(spark, sf_dir, condition), INGEST_TIMES[0])


def _sums(spark, sf_dir):
    return ml.map_sum(
        ml.flatten_metrics(shapes.sum_requests(shapes.table(spark, sf_dir, "lineitem")))
    )


def _mixed(spark, sf_dir):
    return shapes.mixed_requests(shapes.table(spark, sf_dir, "orders"))


def _rejectable(spark, sf_dir):
    return ml.flatten_metrics(shapes.reject_requests(_events(spark, sf_dir)))


def _raw_points(spark, sf_dir):
    """Wire points of the attribute shape."""
    flat = ml.flatten_metrics(shapes.attribute_requests(_events(spark, sf_dir)))
    return flat.selectExpr("ServiceName", "explode(gauge.dataPoints) as p").withColumn(
        "m", attr.kv_to_map(F.col("p.attributes"))
    )


def _key_md5():
    """md5 of the canonical key of a catalogue row."""
    return F.md5(
        identity.canonical_key(
            *[F.col(c) for c in (
                "MetricName", "MetricType", "ResourceSchemaUrl", "ScopeName", "ScopeVersion",
                "ResourceAttributes", "Attributes",
            )]
        )
    ).alias("series_key")


def _text(map_column):
    """A map as sorted text."""
    return F.array_join(
        common.apply_sql(
            F.col(map_column), "m",
            "transform(sort_array(map_entries(m)), e -> concat(e.key, '=', e.value))",
        ),
        ";",
    )


def _values(table):
    """Columns of a point table, arrays as text."""
    first = ["TimeUnixNano", "cast(TimeDate as string) as day"]
    if table in ("gauge", "sum"):
        more = ["Value"]
        if table == "sum":
            more += ["AggregationTemporality", "IsMonotonic"]
        else:
            more += ["StartTimeUnixNano", "Flags"]
        return first + more
    if table == "summary":
        return [
            *first, "Count", "Sum", "ValueAtQuantiles[0].Value as low",
            "ValueAtQuantiles[1].Value as high", "ValueAtQuantiles[1].Quantile as top",
        ]
    if table == "histogram":
        return [
            *first, "Count", "Sum", "array_join(BucketCounts, ',') as buckets",
            "array_join(ExplicitBounds, ',') as bounds", "Min", "Max", "AggregationTemporality",
        ]
    return [
        *first, "Count", "Sum", "Scale", "ZeroCount", "PositiveOffset",
        "array_join(PositiveBucketCounts, ',') as buckets", "NegativeOffset",
        "array_join(NegativeBucketCounts, ',') as negatives", "Min", "Max", "AggregationTemporality",
    ]


def _shaped(spark, sf_dir, table):
    shape, source = {
        "gauge": (shapes.gauge_requests, "events"),
        "sum": (shapes.sum_requests, "lineitem"),
        "histogram": (shapes.histogram_requests, "orders"),
        "exponential_histogram": (shapes.exponential_requests, "lineitem"),
        "summary": (shapes.summary_requests, "orders"),
    }[table]
    return ml.flatten_metrics(shape(shapes.table(spark, sf_dir, source)))


# ---------------------------------------------------------------- A: sources


@query
def a1_read_requests(spark, sf_dir):
    path = scratch_path(spark, "json")
    shapes.gauge_requests(_events(spark, sf_dir)).write.json(path)
    points = ml.map_gauge(ml.flatten_metrics(ml.read_requests(spark, path)))
    return points.select("MetricName", "ServiceName", "TimeUnixNano", "Value", "Flags")


@query
def a2_stream_requests(spark, sf_dir):
    out = scratch_path(spark, "a2")
    stream = ml.stream_requests(spark, f"{landed(spark, sf_dir)}/*", "parquet", max_files=4)
    points = ml.map_gauge(ml.flatten_metrics(stream))
    (
        points.select("MetricName", "TimeUnixNano", "Value")
        .writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows", format="parquet")
        .awaitTermination()
    )
    schema = "MetricName STRING, TimeUnixNano BIGINT, Value DOUBLE"
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query
def a3_scan_series(spark, sf_dir):
    rows = ml.scan_series(
        spark, stored(spark, sf_dir), ["SeriesID", "MetricType", "MetricName", "ServiceName"]
    )
    return rows.groupBy("MetricType", "MetricName", "ServiceName").agg(
        F.countDistinct("SeriesID").alias("series")
    )


def _scan(table):
    def run(spark, sf_dir):
        return ml.scan_points(spark, stored(spark, sf_dir), table).selectExpr(*_values(table))

    return run


QUERIES["a4_scan_gauge"] = _scan("gauge")
QUERIES["a5_scan_sum"] = _scan("sum")
QUERIES["a6_scan_histogram"] = _scan("histogram")
QUERIES["a7_scan_exponential_histogram"] = _scan("exponential_histogram")
QUERIES["a8_scan_summary"] = _scan("summary")


# ---------------------------------------------------------------- B: flatten, map


@query
def b1_flatten_metrics(spark, sf_dir):
    flat = ml.flatten_metrics(_mixed(spark, sf_dir))
    return flat.groupBy("ServiceName", "ScopeName", "ScopeVersion", "MetricName", "MetricUnit").agg(
        F.count(F.lit(1)).alias("metrics")
    )


@query
def b2_route(spark, sf_dir):
    flat = ml.flatten_metrics(_mixed(spark, sf_dir))
    routed = [ml.route(flat, t).select("MetricType", "MetricName") for t in POINT_TABLES]
    return reduce(DataFrame.unionAll, routed).groupBy("MetricType", "MetricName").agg(
        F.count(F.lit(1)).alias("metrics")
    )


def _map(table):
    def run(spark, sf_dir):
        points = ml.map_points(_shaped(spark, sf_dir, table), table)
        return points.selectExpr(
            "MetricName", "MetricUnit", "ServiceName", "md5(SeriesKey) as series_key",
            *_values(table),
        )

    return run


QUERIES["b3_map_gauge"] = _map("gauge")
QUERIES["b4_map_sum"] = _map("sum")
QUERIES["b5_map_histogram"] = _map("histogram")
QUERIES["b6_map_exponential_histogram"] = _map("exponential_histogram")
QUERIES["b7_map_summary"] = _map("summary")


@query
def b8_series_rows(spark, sf_dir):
    return _series(spark, sf_dir).select(
        _key_md5(), "MetricType", "MetricName", "ServiceName", _text("ScopeAttributes").alias("scope"),
        "ScopeSchemaUrl", F.unix_seconds("FirstSeen").alias("first_seen"),
        F.unix_seconds("LastSeen").alias("last_seen"),
    )


@query
def b9_slim(spark, sf_dir):
    points = ml.slim(ml.map_sum(_shaped(spark, sf_dir, "sum")), "sum")
    return points.selectExpr(*_values("sum"), f"{len(points.columns)} as columns")


@query
def b10_quantile_values(spark, sf_dir):
    wire = _shaped(spark, sf_dir, "summary").selectExpr("explode(summary.dataPoints) as p")
    stored_form = quantiles.quantile_values(F.col("p.quantileValues"))
    return wire.select(
        F.col("p.timeUnixNano").cast("bigint").alias("nanos"), F.inline(stored_form)
    ).selectExpr("nanos", "Quantile as quantile", "Value as value")


@query
def b11_split_quantiles(spark, sf_dir):
    points = ml.scan_points(spark, stored(spark, sf_dir), "summary")
    levels, values = quantiles.split_quantiles(F.col("ValueAtQuantiles"))
    return points.select(
        "TimeUnixNano", F.size(levels).alias("levels"), F.array_max(levels).alias("top"),
        F.array_min(values).alias("low"), F.array_max(values).alias("high"),
    )


@query
def b12_map_requests(spark, sf_dir):
    mapped = ml.map_requests(_mixed(spark, sf_dir), INGEST_TIMES[0])
    counted = [frame.select(F.lit(name).alias("table")) for name, frame in mapped.items()]
    return reduce(DataFrame.unionAll, counted).groupBy("table").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- C: validate, filter


@query
def c1_empty_metric_name(spark, sf_dir):
    flat = _rejectable(spark, sf_dir)
    bad = nameless_rejects(nameless_metrics(flat)).select("reason", F.lit(True).alias("rejected"))
    good = named_metrics(flat).select(F.lit("").alias("reason"), F.lit(False).alias("rejected"))
    return bad.unionAll(good).groupBy("reason", "rejected").agg(F.count(F.lit(1)).alias("metrics"))


@query
def c2_zero_timestamp(spark, sf_dir):
    points = ml.candidate_points(_rejectable(spark, sf_dir), "gauge")
    return points.groupBy("MetricName").agg(
        F.count_if(F.col("reason") == "zero_timestamp").alias("zero"),
        F.count(F.lit(1)).alias("points"),
    )


@query
def c3_invalid_value(spark, sf_dir):
    points = ml.candidate_points(_rejectable(spark, sf_dir), "gauge")
    return points.groupBy("MetricName").agg(
        F.count_if(F.col("reason") == "invalid_value").alias("invalid"),
        F.count_if(F.isnan("Value")).alias("nan"),
    )


@query
def c4_validate(spark, sf_dir):
    ok, bad = ml.validate(ml.candidate_points(_rejectable(spark, sf_dir), "gauge"))
    sides = ok.select("MetricName", F.lit("accepted").alias("outcome")).unionAll(
        bad.select("MetricName", F.col("reason").alias("outcome"))
    )
    return sides.groupBy("MetricName", "outcome").agg(F.count(F.lit(1)).alias("points"))


def _catalogue(spark, sf_dir):
    return ml.compact_series(ml.scan_series(spark, stored(spark, sf_dir)))


def _described(series):
    return series.select(_key_md5(), "MetricName", "ServiceName", _text("Attributes").alias("attrs"))


@query
def c5_where_metric(spark, sf_dir):
    rows = ml.where_metric(ml.scan_series(spark, stored(spark, sf_dir)), METRIC)
    return _described(ml.compact_series(rows))


def _one_k(spark, sf_dir):
    """Series of one metric and one value of k."""
    return ml.where_attribute(
        ml.where_metric(ml.scan_series(spark, stored(spark, sf_dir)), METRIC), "point", "k", "42"
    )


# Series IDs that a list may state.
MOST_IDS = 64


def _series_ids(spark, sf_dir):
    """Their IDs: the short list that a user would state; at most one per user group, 21 in all."""
    found = _one_k(spark, sf_dir).select("SeriesID").distinct().limit(MOST_IDS + 1).collect()
    if len(found) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} series: no short list; join them with points_of")
    return sorted(r.SeriesID for r in found)


def _zoned(spark, sf_dir):
    """The store, its gauges noted in the zone map."""
    base = stored(spark, sf_dir)
    ml.write_zone_map(spark, base, "gauge")
    return base


@query
def c6_where_series(spark, sf_dir):
    ids = _series_ids(spark, sf_dir)
    points = ml.scan_points_of(spark, _zoned(spark, sf_dir), "gauge", ids)
    return points.select("TimeUnixNano", "Value")


@query
def c7_time_range(spark, sf_dir):
    points = ml.scan_points(spark, stored(spark, sf_dir), "gauge")
    return ml.time_range(points, RANGE_START, RANGE_END).select("TimeUnixNano", "Value", "Flags")


@query
def c8_where_attribute(spark, sf_dir):
    series = _catalogue(spark, sf_dir)
    found = [
        ml.where_attribute(series, "resource", "host.name", "h1").withColumn("by", F.lit("value")),
        ml.where_attribute(series, "scope", "team", "t1").withColumn("by", F.lit("scope")),
        ml.where_attribute(series, "point", "returnflag").withColumn("by", F.lit("key")),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("by", "MetricName").agg(
        F.count(F.lit(1)).alias("series")
    )


@query
def c9_where_service(spark, sf_dir):
    # The service isn't part of the identity: only the newest version of a series counts.
    return _described(ml.where_service(_catalogue(spark, sf_dir), SERVICE))


# ---------------------------------------------------------------- D: identity


@query
def d1_canonical_key(spark, sf_dir):
    flat = ml.flatten_metrics(shapes.attribute_requests(_events(spark, sf_dir)))
    return ml.map_gauge(flat).select(
        "TimeUnixNano", F.md5("SeriesKey").alias("series_key"),
        F.length("SeriesKey").alias("key_length"),
    )


@query
def d2_series_id(spark, sf_dir):
    sides = [
        points.select("MetricName", "SeriesID", "SeriesKey")
        for points in (_gauges(spark, sf_dir), _sums(spark, sf_dir))
    ]
    # Keys are grouped first, in a hash table: the least and greatest text of many rows would sort them all.
    per_key = reduce(DataFrame.unionAll, sides).groupBy("MetricName", "SeriesID", "SeriesKey").agg(
        F.count(F.lit(1)).alias("points")
    )
    per_id = per_key.groupBy("MetricName", "SeriesID").agg(
        F.sum("points").alias("points"),
        F.min("SeriesKey").alias("low"),
        F.max("SeriesKey").alias("high"),
    )
    return per_id.groupBy("MetricName").agg(
        F.count(F.lit(1)).alias("ids"),
        F.count_if(F.col("low") != F.col("high")).alias("collisions"),
        F.sum("points").alias("points"),
    )


@query
def d3_sorted_keys(spark, sf_dir):
    rows = _raw_points(spark, sf_dir)
    return rows.select(
        F.col("p.timeUnixNano").cast("bigint").alias("nanos"),
        F.array_join(identity.sorted_keys(F.col("m")), ",").alias("keys"),
    )


# ---------------------------------------------------------------- E: catalogue


@query
def e1_distinct_series(spark, sf_dir):
    return ml.distinct_series(_series(spark, sf_dir)).select(_key_md5(), "MetricName", "ServiceName")


@query
def e2_new_series(spark, sf_dir):
    catalogue = ml.distinct_series(_series(spark, sf_dir, CATALOGUE_CUT))
    batch = _series(spark, sf_dir, f"not ({CATALOGUE_CUT})")
    return ml.new_series(batch, catalogue).select(_key_md5(), "MetricName", "ServiceName")


@query
def e2s_new_series_stream(spark, sf_dir):
    out = scratch_path(spark, "e2s")
    stream = ml.stream_requests(spark, f"{landed(spark, sf_dir)}/*", "parquet", max_files=4)
    points = ml.map_gauge(ml.flatten_metrics(stream))
    series = ml.series_rows(points, F.current_timestamp())
    (
        ml.new_series_stream(series, "1 hour")
        .select(_key_md5(), "MetricName", "ServiceName")
        .writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows", format="parquet")
        .awaitTermination()
    )
    schema = "series_key STRING, MetricName STRING, ServiceName STRING"
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query
def e2s_store_new_series(spark, sf_dir):
    """New series of the stream, found on their IDs; with an hour's horizon each is stored once."""
    base = scratch_path(spark, "e2s-store")
    stream = ml.stream_requests(spark, f"{landed(spark, sf_dir)}/*", "parquet", max_files=4)
    series = ml.series_rows(ml.map_gauge(ml.flatten_metrics(stream)), F.current_timestamp())
    ml.store_new_series(series, base, f"{base}/checkpoint", timedelta(hours=1))
    return ml.scan_series(spark, base).select(_key_md5(), "MetricName", "ServiceName")


def _versions(spark, sf_dir):
    """Catalogue rows with one version per event: the description and the write differ."""
    requests = shapes.gauge_requests(_events(spark, sf_dir), "concat('v', event_id)")
    rows = ml.series_rows(ml.map_gauge(ml.flatten_metrics(requests)), F.col("TimeUnix"))
    return rows.withColumn("write", F.expr("cast(substr(MetricDescription, 2) as bigint)"))


def _latest(series):
    return series.select(
        _key_md5(), "MetricDescription", F.unix_seconds("FirstSeen").alias("first_seen"),
        F.unix_seconds("LastSeen").alias("last_seen"),
    )


@query
def e3_compact_series(spark, sf_dir):
    return _latest(ml.compact_series(_versions(spark, sf_dir)))


@query
def e3b_compact_series_first_seen(spark, sf_dir):
    return _latest(ml.compact_series(_versions(spark, sf_dir), keep_first_seen=True))


# ---------------------------------------------------------------- F: joins


@query
def f1_enrich_gauge(spark, sf_dir):
    base = stored(spark, sf_dir)
    rows = ml.enrich(ml.scan_points(spark, base, "gauge"), ml.scan_series(spark, base))
    return rows.select(
        "MetricName", "ServiceName", _text("Attributes").alias("attrs"), "TimeUnixNano", "Value"
    )


@query
def f1_enrich_sum(spark, sf_dir):
    base = stored(spark, sf_dir)
    rows = ml.enrich(ml.scan_points(spark, base, "sum"), ml.scan_series(spark, base))
    return rows.select(
        "MetricName", "MetricUnit", "ServiceName", _text("Attributes").alias("attrs"),
        "TimeUnixNano", "Value",
    )


@query
def f2_orphans(spark, sf_dir):
    series = _series(spark, sf_dir).filter(F.col("ServiceName") != SERVICE)
    return ml.orphans(_gauges(spark, sf_dir), series).select("MetricName", "TimeUnixNano", "Value")


@query
def f3_points_where(spark, sf_dir):
    points = ml.scan_points(spark, stored(spark, sf_dir), "gauge")
    predicate = ml.attribute_predicate("resource", "host.name", "h1")
    return ml.points_where(points, _catalogue(spark, sf_dir), predicate).select(
        "TimeUnixNano", "Value"
    )


@query
def f4_series_over_time(spark, sf_dir):
    ids = _one_k(spark, sf_dir)
    points = ml.scan_points_of(spark, _zoned(spark, sf_dir), "gauge", ids, RANGE_START, RANGE_END)
    return ml.series_over_time(points, ids, RANGE_START, RANGE_END).select("TimeUnixNano", "Value")


# ---------------------------------------------------------------- G: aggregates


@query
def g1_count_series(spark, sf_dir):
    return ml.count_series(_catalogue(spark, sf_dir), F.col("MetricName") == METRIC)


@query
def g2_count_points(spark, sf_dir):
    points = ml.scan_points(spark, stored(spark, sf_dir), "gauge")
    return ml.count_points(points, _catalogue(spark, sf_dir), F.col("MetricName") == METRIC)


@query
def g3_count_all(spark, sf_dir):
    return ml.count_all(ml.scan_points(spark, stored(spark, sf_dir), "sum"))


@query
def g4_processed_by_type(spark, sf_dir):
    return ml.processed_by_type(ml.map_requests(_mixed(spark, sf_dir), INGEST_TIMES[0]))


@query
def g5_skipped_by_reason(spark, sf_dir):
    requests = shapes.reject_requests(_events(spark, sf_dir))
    return ml.skipped_by_reason(ml.map_requests(requests, INGEST_TIMES[0])["rejects"])


@query
def g6_series_hit_miss(spark, sf_dir):
    catalogue = ml.distinct_series(_series(spark, sf_dir, CATALOGUE_CUT))
    return ml.series_hit_miss(_series(spark, sf_dir, f"not ({CATALOGUE_CUT})"), catalogue)


@query
def g7_requests_received(spark, sf_dir):
    return ml.requests_received(ml.read_requests(spark, f"{landed(spark, sf_dir)}/*", "parquet"))


@query
def g8_batch_sizes(spark, sf_dir):
    return ml.batch_sizes(ml.scan_rows(spark, stored(spark, sf_dir), "ledger")).drop("writer")


@query
def g9_write_stats(spark, sf_dir):
    stats = ml.write_stats(ml.scan_rows(spark, stored(spark, sf_dir), "ledger"))
    # Durations differ from run to run; what holds of them in any run is compared.
    bounded = (F.col("max_ms") >= 0) & (F.col("max_ms") <= F.col("total_ms"))
    summed = F.col("total_ms") <= F.col("max_ms") * F.col("writes")
    return stats.select("table", "writes", "failures", "rows", (bounded & summed).alias("times_fit"))


# ---------------------------------------------------------------- H: sinks and layout


@query
def h1_write_series(spark, sf_dir):
    base = scratch_path(spark, "h1")
    ml.create_tables(spark, base)
    ml.write_series(ml.distinct_series(_series(spark, sf_dir)), base, 0)
    return _described(ml.scan_series(spark, base))


def _roundtrip(table):
    def run(spark, sf_dir):
        base = scratch_path(spark, table)
        points = ml.slim(ml.map_points(_shaped(spark, sf_dir, table), table), table)
        ml.write_points(points, table, base, 0)
        return ml.scan_points(spark, base, table).selectExpr(*_values(table))

    return run


QUERIES["h2_write_gauge"] = _roundtrip("gauge")
QUERIES["h3_write_sum"] = _roundtrip("sum")
QUERIES["h4_write_histogram"] = _roundtrip("histogram")
QUERIES["h5_write_exponential_histogram"] = _roundtrip("exponential_histogram")
QUERIES["h6_write_summary"] = _roundtrip("summary")


@query
def h7_physical_layout(spark, sf_dir):
    """Points per day directory, and how many lie in a directory of another day."""
    rows = ml.scan_points(spark, stored(spark, sf_dir), "gauge").withColumn(
        "folder", F.regexp_extract(F.col("_metadata.file_path"), "TimeDate=([0-9-]+)", 1)
    )
    day = times.nanos_to_date(F.col("TimeUnixNano")).cast("string")
    return rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(day != F.col("folder")).alias("misplaced")
    )


@query
def h7_merge_points(spark, sf_dir):
    """Batches merged one after the other, each twice, hold the same points after a clean-up."""
    base = scratch_path(spark, "merge")
    points = ml.slim(_gauges(spark, sf_dir), "gauge")
    for batch_id in (0, 1):
        half = points.filter(F.col("Flags") == batch_id)
        ml.write_points(half, "gauge", base, batch_id)
        # The second time there is nothing new, which must change nothing.
        for _ in range(2):
            ml.merge_points(spark, base, "gauge")
    ml.remove_superseded(spark, base)
    return ml.scan_points(spark, base, "gauge").selectExpr(*_values("gauge"))


@query
def h7_batch_below_a_merge(spark, sf_dir):
    """Batches 5 and 8 are merged, then batch 1 comes; a clean-up keeps all of it."""
    base = scratch_path(spark, "late")
    points = ml.slim(_gauges(spark, sf_dir), "gauge")
    part = F.pmod(F.col("TimeUnixNano").bitwiseXOR(F.col("SeriesID")), F.lit(3))
    for k, batch_id in enumerate((5, 8)):
        ml.write_points(points.filter(part == k), "gauge", base, batch_id)
    ml.merge_points(spark, base, "gauge")
    ml.write_points(points.filter(part == 2), "gauge", base, 1)
    ml.remove_superseded(spark, base)
    return ml.scan_points(spark, base, "gauge").selectExpr(*_values("gauge"))


def _row_counts(spark, base):
    frames = {t: ml.scan_points(spark, base, t) for t in POINT_TABLES}
    frames["series"] = ml.compact_series(ml.scan_series(spark, base))
    counted = [f.select(F.lit(t).alias("table")) for t, f in frames.items()]
    return reduce(DataFrame.unionAll, counted).groupBy("table").agg(F.count(F.lit(1)).alias("rows"))


@query
def h8_create_tables(spark, sf_dir):
    """Making the tables again leaves the stored rows alone."""
    base = stored(spark, sf_dir)
    ml.create_tables(spark, base)
    return _row_counts(spark, base)


@query
def h9_empty_batch(spark, sf_dir):
    """A batch whose points were all rejected adds no points; its rejects are kept."""
    base = scratch_path(spark, "h9")
    ml.create_tables(spark, base)
    ok, bad = ml.validate(ml.candidate_points(_rejectable(spark, sf_dir), "gauge"))
    ml.write_points(ml.slim(identified(ok.filter("false")), "gauge"), "gauge", base, 0)
    write_rejects(bad, base, 0)
    rejects = ml.scan_rows(spark, base, "rejects").select(F.lit("rejects").alias("table"))
    points = ml.scan_points(spark, base, "gauge").select(F.lit("gauge").alias("table"))
    return points.unionAll(rejects).groupBy("table").agg(F.count(F.lit(1)).alias("rows"))


@query
def h10_optimize_series(spark, sf_dir):
    base = scratch_path(spark, "h10")
    ml.create_tables(spark, base)
    for batch_id, cut in enumerate((CATALOGUE_CUT, f"not ({CATALOGUE_CUT})")):
        ml.write_series(ml.distinct_series(_series(spark, sf_dir, cut)), base, batch_id)
    before = ml.scan_series(spark, base).select(F.lit("before").alias("state"))
    ml.optimize_series(spark, base)
    after = ml.scan_series(spark, base).select(F.lit("after").alias("state"))
    return before.unionAll(after).groupBy("state").agg(F.count(F.lit(1)).alias("rows"))


@query
def i1_bloom_lookup(spark, sf_dir):
    """A lookup by the two scalar columns that carry bloom filters."""
    series = ml.where_metric(ml.scan_series(spark, stored(spark, sf_dir)), METRIC)
    found = ml.where_service(ml.compact_series(series), SERVICE)
    return found.groupBy("MetricName", "ServiceName").agg(
        F.countDistinct("SeriesID").alias("series")
    )


def _indexed(spark, sf_dir):
    """A catalogue of gauges in two batches, indexed after the first."""
    base = scratch_path(spark, "i2")
    for batch_id, cut in enumerate((CATALOGUE_CUT, f"not ({CATALOGUE_CUT})")):
        ml.write_series(ml.distinct_series(_series(spark, sf_dir, cut)), base, batch_id)
        if not batch_id:
            ml.write_attribute_index(spark, base)
    return base


@query
def i2_attribute_index(spark, sf_dir):
    base = stored(spark, sf_dir)
    ml.write_attribute_index(spark, base)
    return ml.scan_attribute_index(spark, base).groupBy("scope", "key", "value").agg(
        F.count(F.lit(1)).alias("series")
    )


@query
def i2_points_by_index(spark, sf_dir):
    """The answer of f3_points_where, by way of an index older than half of the series."""
    index = ml.scan_attribute_index(spark, _indexed(spark, sf_dir))
    points = ml.scan_points(spark, stored(spark, sf_dir), "gauge")
    return ml.points_of(points, ml.indexed_series(index, "resource", "host.name", "h1")).select(
        "TimeUnixNano", "Value"
    )


# ---------------------------------------------------------------- J: streaming


def _report(spark, base):
    """Points, series and orphans of every table of a store."""
    series = ml.scan_series(spark, base, ["SeriesID"])
    parts = []
    for table in POINT_TABLES:
        points = ml.scan_points(spark, base, table).select("SeriesID")
        lost = ml.orphans(points, series)
        parts.append(
            points.select(F.lit(table).alias("table"), "SeriesID", F.lit(0).alias("orphan")).unionAll(
                lost.select(F.lit(table), "SeriesID", F.lit(1))
            )
        )
    per_series = reduce(DataFrame.unionAll, parts).groupBy("table", "SeriesID").agg(
        F.count_if(F.col("orphan") == 0).alias("points"), F.sum("orphan").alias("orphans")
    )
    return per_series.groupBy("table").agg(
        F.sum("points").alias("points"),
        F.count(F.lit(1)).alias("series"),
        F.sum("orphans").alias("orphans"),
    )


def _stream(spark, sf_dir, **caps):
    return ml.stream_requests(spark, f"{landed(spark, sf_dir)}/*", "parquet", **caps)


@query
def j1_j2_continuous_ingest(spark, sf_dir):
    base = scratch_path(spark, "j1")
    running = ml.start_ingest(_stream(spark, sf_dir), base, f"{base}/checkpoint", "1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return _report(spark, base)


@query
def j3_j4_drain_in_capped_batches(spark, sf_dir):
    base = scratch_path(spark, "j4")
    ml.drain(_stream(spark, sf_dir, max_files=8), base, f"{base}/checkpoint")
    return _report(spark, base)


# Points of a write, at the most.
FLUSH = 40_000


@query
def j3_row_bounded(spark, sf_dir):
    """A backlog drained in one trigger: all points, and how many writes hold more than FLUSH."""
    base = scratch_path(spark, "j3")
    ml.drain(_stream(spark, sf_dir), base, f"{base}/checkpoint", max_points=FLUSH)
    number = F.regexp_extract(F.col("_metadata.file_path"), "write=([0-9]+)", 1).alias("write")
    stored_points = reduce(
        DataFrame.unionAll, [ml.scan_points(spark, base, t).select(number) for t in POINT_TABLES]
    )
    return stored_points.groupBy("write").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("points"), F.count_if(F.col("n") > FLUSH).alias("above")
    )


@query
def j1_two_streams(spark, sf_dir):
    """Two streams, each with a checkpoint and batch ids of its own, into one base; one starts again."""
    base = scratch_path(spark, "j1-two")
    for part in (0, 1, 0):
        stream = ml.stream_requests(spark, f"{landed(spark, sf_dir)}/part{part}", "parquet")
        ml.drain(stream, base, f"{base}/checkpoint{part}")
    return _report(spark, base)


@query
def j5_replayed_batch(spark, sf_dir):
    """The second of two batches is stored twice, as after a crash before its commit."""
    base = scratch_path(spark, "j5")
    path = landed(spark, sf_dir)
    for part in (0, 1, 1):
        ingest_files(spark, f"{path}/part{part}", base, part, INGEST_TIMES[part])
    return _report(spark, base)


# ---------------------------------------------------------------- K: scalar functions


def _nanos():
    return F.col("p.timeUnixNano").cast("bigint").alias("nanos")


@query
def k1_any_value_to_string(spark, sf_dir):
    rows = _raw_points(spark, sf_dir).select("p.timeUnixNano", F.explode("p.attributes").alias("a"))
    return rows.select(
        F.col("timeUnixNano").cast("bigint").alias("nanos"),
        F.col("a.key").alias("key"),
        attr.any_value_to_string(F.col("a.value")).alias("text"),
    )


@query
def k2_double_to_g(spark, sf_dir):
    lines = shapes.table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        numbers.double_to_g(F.col("l_extendedprice")).alias("plain"),
        numbers.double_to_g(F.col("l_extendedprice") * F.lit(1000.0)).alias("large"),
        numbers.double_to_g(F.col("l_extendedprice") / F.lit(-3e9)).alias("small"),
    )


@query
def k3_complex_value_to_string(spark, sf_dir):
    rows = _raw_points(spark, sf_dir).select("p.timeUnixNano", F.explode("p.attributes").alias("a"))
    return rows.filter("a.key in ('kv', 'list', 'raw')").select(
        F.col("timeUnixNano").cast("bigint").alias("nanos"),
        F.col("a.key").alias("key"),
        attr.complex_value_to_string(F.col("a.value")).alias("text"),
    )


@query
def k4_kv_to_map(spark, sf_dir):
    rows = _raw_points(spark, sf_dir)
    return rows.select(_nanos(), F.expr("m['dup']").alias("dup"), F.size("m").alias("keys"))


@query
def k5_strip_empty_keys(spark, sf_dir):
    kept = attr.strip_empty_keys(F.col("p.attributes"))
    rows = _raw_points(spark, sf_dir)
    return rows.select(
        _nanos(), F.size("p.attributes").alias("before"), F.size(kept).alias("after")
    )


@query
def k6_service_name(spark, sf_dir):
    flat = ml.flatten_metrics(shapes.attribute_requests(_events(spark, sf_dir)))
    mapped = F.expr("ResourceAttributes['service.name']")
    return flat.groupBy("ServiceName", mapped.alias("mapped")).agg(
        F.count(F.lit(1)).alias("metrics")
    )


@query
def k7_nanos_to_time(spark, sf_dir):
    shifted = F.col("nanos") - F.lit(1_705_000_000_000_000_000) + F.col("event_id")
    rows = _events(spark, sf_dir).selectExpr(
        "event_id", f"cast({shapes.nanos('ts')} as bigint) as nanos"
    ).select("event_id", shifted.alias("n"))
    return rows.select(
        "event_id", "n", F.unix_micros(times.nanos_to_timestamp(F.col("n"))).alias("micros"),
        times.nanos_to_date(F.col("n")).cast("string").alias("day"),
    )


@query
def k8_number_value(spark, sf_dir):
    rows = _raw_points(spark, sf_dir)
    return rows.select(_nanos(), numbers.number_value(F.col("p")).alias("value"))


@query
def k9_is_finite(spark, sf_dir):
    odd = F.expr(
        "case event_id % 4 when 0 then double('NaN') when 1 then double('Infinity') "
        "when 2 then double('-Infinity') else value end"
    )
    return _events(spark, sf_dir).select(
        "event_id", numbers.is_finite(F.col("value")).alias("plain"),
        numbers.is_finite(odd).alias("odd"),
    )


@query
def k10_map_keys_values(spark, sf_dir):
    series = _catalogue(spark, sf_dir)
    keys = series.select(
        "MetricName", F.lit("key").alias("part"),
        F.explode(attr.attribute_keys(F.col("Attributes"))).alias("text"),
    )
    values = series.select(
        "MetricName", F.lit("value"), F.explode(attr.attribute_values(F.col("Attributes")))
    )
    return keys.unionAll(values).groupBy("MetricName", "part", "text").agg(
        F.count(F.lit(1)).alias("series")
    )


@query
def k11_unix_nanos(spark, sf_dir):
    points = ml.scan_points(spark, stored(spark, sf_dir), "sum")
    key = times.unix_nanos()
    return points.groupBy(F.col("TimeDate").cast("string").alias("day")).agg(
        F.min(key).alias("first"), F.max(key).alias("last")
    )


@query
def k12_or_default(spark, sf_dir):
    wire = _shaped(spark, sf_dir, "exponential_histogram").selectExpr(
        "explode(exponentialHistogram.dataPoints) as p"
    )
    return wire.select(
        _nanos(), F.col("p.count").cast("bigint").alias("count"),
        F.col("p.min").isNull().alias("unset"),
        common.or_default(F.col("p.min"), 0.0).alias("min"),
        common.or_default(F.col("p.negative.offset"), 0).alias("negative_offset"),
    )
