"""Spark-native telemetry metrics engine.

Flatten, validate, fingerprint, deduplicate, store and query metric export
requests with DataFrames and Structured Streaming.
"""

from metricloom.functions.identity import canonical_key, series_id
from metricloom.operators.aggregates import (
    batch_sizes,
    count_all,
    count_points,
    count_series,
    processed_by_type,
    requests_received,
    series_hit_miss,
    skipped_by_reason,
    write_stats,
)
from metricloom.operators.catalogue import (
    attribute_index,
    compact_series,
    distinct_series,
    new_series,
)
from metricloom.operators.filters import (
    attribute_predicate,
    indexed_series,
    time_range,
    where_attribute,
    where_metric,
    where_series,
    where_service,
)
from metricloom.operators.flatten import flatten_metrics, route
from metricloom.operators.joins import enrich, orphans, points_of, points_where, series_over_time
from metricloom.operators.mapping import (
    candidate_points,
    map_exponential_histogram,
    map_gauge,
    map_histogram,
    map_points,
    map_rejects,
    map_requests,
    map_series,
    map_sum,
    map_summary,
    series_rows,
    slim,
)
from metricloom.operators.validate import validate
from metricloom.plans.ingest import ingest_files, write_batch
from metricloom.sources.requests import (
    land_requests,
    read_requests,
    stream_kafka_requests,
    stream_requests,
    unreadable_rejects,
)
from metricloom.sources.tables import (
    create_tables,
    merge_attribute_index,
    merge_points,
    optimize_series,
    remove_superseded,
    scan_attribute_index,
    scan_points,
    scan_rows,
    scan_series,
    write_attribute_index,
    write_points,
    write_series,
)
from metricloom.sources.zones import scan_points_of, write_zone_map
from metricloom.streaming.dedup import new_series_stream, store_new_series
from metricloom.streaming.ingest import drain, ingest_micro_batch, start_ingest
