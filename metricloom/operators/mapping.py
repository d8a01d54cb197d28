"""Metrics to typed points, series rows and rejects."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.attributes import (
    attribute_entries_sql,
    attribute_pairs_sql,
    entries_to_map_sql,
    pairs_to_entries_sql,
    service_name_sql,
)
from metricloom.functions.common import counts64_sql, wrapped_int64_sql
from metricloom.functions.identity import canonical_key_sql, entries_section_sql, series_id_sql
from metricloom.functions.numbers import number_value_sql
from metricloom.functions.quantiles import quantile_values_sql
from metricloom.functions.times import nanos_to_date_sql, nanos_to_timestamp_sql
from metricloom.operators.flatten import (
    METRIC_COLUMNS,
    RESOURCE_COLUMNS,
    SCOPE_COLUMNS,
    flatten_metrics,
    named_metrics,
    nameless_metrics,
    route,
)
from metricloom.operators.validate import accepted, nameless_rejects, point_reason_sql, validate
from metricloom.schema import POINT_TABLES, POINTS, SERIES, column_names

_TEMPORALITY = {"AggregationTemporality": "coalesce(_temporality, 0)"}
_EXTREMES = {"Min": "coalesce(_point.min, 0D)", "Max": "coalesce(_point.max, 0D)"}
_TOTALS = {"Count": wrapped_int64_sql("_point.count"), "Sum": "coalesce(_point.sum, 0D)"}

# Table -> SQL of its columns beside the common ones. Unset fields get their zero value.
VALUE_COLUMNS = {
    "gauge": {"Value": number_value_sql("_point")},
    "sum": {
        "Value": number_value_sql("_point"),
        **_TEMPORALITY,
        "IsMonotonic": "coalesce(_monotonic, false)",
    },
    "histogram": {
        **_TOTALS,
        "BucketCounts": counts64_sql("_point.bucketCounts"),
        "ExplicitBounds": "coalesce(_point.explicitBounds, cast(array() as array<double>))",
        **_EXTREMES,
        **_TEMPORALITY,
    },
    "exponential_histogram": {
        **_TOTALS,
        "Scale": "coalesce(_point.scale, 0)",
        "ZeroCount": wrapped_int64_sql("_point.zeroCount"),
        "PositiveOffset": "coalesce(_point.positive.offset, 0)",
        "PositiveBucketCounts": counts64_sql("_point.positive.bucketCounts"),
        "NegativeOffset": "coalesce(_point.negative.offset, 0)",
        "NegativeBucketCounts": counts64_sql("_point.negative.bucketCounts"),
        **_EXTREMES,
        **_TEMPORALITY,
    },
    "summary": {**_TOTALS, "ValueAtQuantiles": quantile_values_sql("_point.quantileValues")},
}
# Table -> SQL of the columns a point takes from its metric.
_PARENT_COLUMNS = {
    "gauge": [],
    "sum": ["sum.aggregationTemporality as _temporality", "sum.isMonotonic as _monotonic"],
    "histogram": ["histogram.aggregationTemporality as _temporality"],
    "exponential_histogram": ["exponentialHistogram.aggregationTemporality as _temporality"],
    "summary": [],
}


_METADATA = [*RESOURCE_COLUMNS, *SCOPE_COLUMNS, *METRIC_COLUMNS, "MetricType"]


def _checked(table: str) -> str:
    """Name of the value whose finiteness is checked."""
    return "Value" if "Value" in VALUE_COLUMNS[table] else "Sum"


def _keyed(points: DataFrame, columns: list[str], checked: str) -> DataFrame:
    """Points with attribute map, canonical key and reject reason beside ``columns``."""
    key = canonical_key_sql(
        "MetricName",
        "MetricType",
        "ResourceSchemaUrl",
        "ScopeName",
        "ScopeVersion",
        "_resource_section",
        entries_section_sql("_entries"),
    )
    return points.selectExpr(
        *[c for c in _METADATA if c != "_resource_section"],
        f"{entries_to_map_sql('_entries')} as Attributes",
        f"{key} as SeriesKey",
        *columns,
        f"{point_reason_sql('TimeUnixNano', checked)} as reason",
    )


def candidate_points(flat: DataFrame, table: str) -> DataFrame:
    """Every point of one type, valid or not, with its ``reason``.

    Carries the series metadata, the point columns and the canonical key. A
    caller that selects a few of them pays for those only.
    """
    _, arm, _ = POINT_TABLES[table]
    exploded = route(flat, table).selectExpr(
        *_METADATA, *_PARENT_COLUMNS[table], f"explode({arm}.dataPoints) as _point"
    )
    typed = exploded.selectExpr(
        *_METADATA,
        f"{attribute_entries_sql('_point.attributes')} as _entries",
        f"{wrapped_int64_sql('_point.startTimeUnixNano')} as StartTimeUnixNano",
        f"{wrapped_int64_sql('_point.timeUnixNano')} as TimeUnixNano",
        "coalesce(_point.flags, 0L) as Flags",
        *[f"{sql} as {name}" for name, sql in VALUE_COLUMNS[table].items()],
    )
    columns = ["StartTimeUnixNano", "TimeUnixNano", "Flags", *VALUE_COLUMNS[table]]
    return _keyed(typed, columns, _checked(table))


def point_heads(flat: DataFrame) -> DataFrame:
    """Every point of all types in one pass, as far as series and rejects need it.

    Same metadata, key, time and ``reason`` as ``candidate_points``, without
    the columns that differ by type.
    """
    arrays = []
    for table, (metric_type, arm, _) in POINT_TABLES.items():
        if arm in flat.columns:
            checked = VALUE_COLUMNS[table][_checked(table)].replace("_point.", "p.")
            head = (
                f"struct('{metric_type}' as type, p.attributes as attributes, "
                f"p.timeUnixNano as nanos, {checked} as checked)"
            )
            arrays.append(f"coalesce(transform({arm}.dataPoints, p -> {head}), array())")
    metadata = [c for c in _METADATA if c != "MetricType"]
    heads = named_metrics(flat).selectExpr(
        *metadata, f"explode(concat({', '.join(arrays)})) as _head"
    )
    typed = heads.selectExpr(
        *metadata,
        "_head.type as MetricType",
        f"{attribute_entries_sql('_head.attributes')} as _entries",
        f"{wrapped_int64_sql('_head.nanos')} as TimeUnixNano",
        "_head.checked as _checked",
    )
    return _keyed(typed, ["TimeUnixNano"], "_checked")


def with_series_id(points: DataFrame) -> DataFrame:
    """Points with the fingerprint of their key."""
    return points.selectExpr(f"{series_id_sql('SeriesKey')} as SeriesID", "*")


def identified(points: DataFrame) -> DataFrame:
    """Points with SeriesID and the derived time columns."""
    return with_series_id(points).selectExpr(
        "*",
        f"{nanos_to_timestamp_sql('StartTimeUnixNano')} as StartTimeUnix",
        f"{nanos_to_timestamp_sql('TimeUnixNano')} as TimeUnix",
        f"{nanos_to_date_sql('TimeUnixNano')} as TimeDate",
    )


def map_points(flat: DataFrame, table: str) -> DataFrame:
    """Accepted points of one type, with metadata and SeriesID."""
    return identified(accepted(candidate_points(flat, table)))


def map_gauge(flat: DataFrame) -> DataFrame:
    """Accepted gauge points."""
    return map_points(flat, "gauge")


def map_sum(flat: DataFrame) -> DataFrame:
    """Accepted sum points, with temporality and monotonicity of their metric."""
    return map_points(flat, "sum")


def map_histogram(flat: DataFrame) -> DataFrame:
    """Accepted histogram points."""
    return map_points(flat, "histogram")


def map_exponential_histogram(flat: DataFrame) -> DataFrame:
    """Accepted exponential-histogram points."""
    return map_points(flat, "exponential_histogram")


def map_summary(flat: DataFrame) -> DataFrame:
    """Accepted summary points."""
    return map_points(flat, "summary")


def series_rows(points: DataFrame, ingest_time: datetime | Column) -> DataFrame:
    """One catalogue row per accepted point; both stamps are the ingest time.

    ``ingest_time`` is a parameter, so a replay writes the same rows.
    """
    stamp = ingest_time if isinstance(ingest_time, Column) else F.lit(ingest_time)
    seconds = F.date_trunc("second", stamp.cast("timestamp"))
    return points.withColumns({"FirstSeen": seconds, "LastSeen": seconds}).selectExpr(
        *column_names(SERIES)
    )


def slim(points: DataFrame, table: str) -> DataFrame:
    """The stored columns of a point: no metadata, only SeriesID."""
    return points.selectExpr(*column_names(POINTS[table]), "TimeDate")


def map_series(flat: DataFrame, ingest_time: datetime | Column) -> DataFrame:
    """B8 for all types: one catalogue row per accepted point."""
    return series_rows(with_series_id(accepted(point_heads(flat))), ingest_time)


def _head_columns(table: str, metric: str) -> list[str]:
    """SQL of the type and of the ``reason`` of a point ``p`` of a metric."""
    metric_type, checked = POINT_TABLES[table][0], VALUE_COLUMNS[table][_checked(table)].replace("_point.", "p.")
    reason = point_reason_sql(wrapped_int64_sql("p.timeUnixNano"), checked)
    return [f"{metric} as MetricName", f"'{metric_type}' as MetricType", f"{reason} as reason"]


def _labels(requests: DataFrame, table: str) -> DataFrame:
    """Labels of the accepted points of a type, with attributes as text in the order they came."""
    resource = {
        "ServiceName": service_name_sql("rm.resource.attributes"),
        "_resource": attribute_pairs_sql("rm.resource.attributes"),
        "ResourceSchemaUrl": "coalesce(rm.schemaUrl, '')",
    }
    scope = {
        "ScopeName": "coalesce(sm.scope.name, '')",
        "ScopeVersion": "coalesce(sm.scope.version, '')",
        "_scope": attribute_pairs_sql("sm.scope.attributes"),
        "ScopeDroppedAttrCount": "coalesce(sm.scope.droppedAttributesCount, 0L)",
        "ScopeSchemaUrl": "coalesce(sm.schemaUrl, '')",
    }
    own = [*resource, *scope]
    scopes = requests.selectExpr("explode(resourceMetrics) as rm").selectExpr(
        *[f"{sql} as {name}" for name, sql in resource.items()], "explode(rm.scopeMetrics) as sm"
    )
    metrics = scopes.selectExpr(
        *resource, *[f"{sql} as {name}" for name, sql in scope.items()], "explode(sm.metrics) as m"
    ).filter("m.name <> ''")
    points = metrics.selectExpr(
        *own,
        "m.name as MetricName",
        "coalesce(m.description, '') as MetricDescription",
        "coalesce(m.unit, '') as MetricUnit",
        f"explode(m.{POINT_TABLES[table][1]}.dataPoints) as p",
    )
    checked = points.selectExpr(
        *own, "MetricDescription", "MetricUnit", *_head_columns(table, "MetricName"), "p.attributes as _attributes"
    )
    return accepted(checked).selectExpr(
        *own, *METRIC_COLUMNS, "MetricType", f"{attribute_pairs_sql('_attributes')} as _point"
    )


def series_of_requests(requests: dict[str, DataFrame], ingest_time: datetime | Column) -> DataFrame:
    """The different rows of ``map_series``, straight from requests with the points of each type.

    Points of a series repeat its labels. They are grouped as they come, as text, in a hash aggregation that
    combines before the shuffle; attributes are sorted and made maps, and keys built and hashed, for what
    is left. Rows whose lists differ in order or in what is dropped from them may still be equal.
    """
    labels = reduce(DataFrame.unionAll, [_labels(rows, table) for table, rows in requests.items()]).distinct()
    lists = {"_resource": "ResourceAttributes", "_scope": "ScopeAttributes", "_point": "Attributes"}
    entries = labels.selectExpr(
        *[c for c in labels.columns if c not in lists], *[f"{pairs_to_entries_sql(c)} as {c}" for c in lists]
    )
    key = canonical_key_sql(
        "MetricName", "MetricType", "ResourceSchemaUrl", "ScopeName", "ScopeVersion",
        entries_section_sql("_resource"), entries_section_sql("_point"),
    )
    keyed = entries.selectExpr(
        "*", *[f"{entries_to_map_sql(c)} as {name}" for c, name in lists.items()], f"{key} as SeriesKey"
    )
    return series_rows(with_series_id(keyed), ingest_time)


def rejects_of_requests(requests: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """C4: the rows of ``map_rejects``, straight from requests with the points of each type, and ``names`` with all metrics."""

    def metrics(rows: DataFrame) -> DataFrame:
        scopes = rows.selectExpr("explode(resourceMetrics) as rm").selectExpr("explode(rm.scopeMetrics) as sm")
        return scopes.selectExpr("explode(sm.metrics) as m").selectExpr("coalesce(m.name, '') as MetricName", "m")

    sides = [nameless_rejects(nameless_metrics(metrics(names)))]
    for table, rows in requests.items():
        points = named_metrics(metrics(rows)).selectExpr(
            "MetricName", f"explode(m.{POINT_TABLES[table][1]}.dataPoints) as p"
        )
        sides.append(validate(points.selectExpr(*_head_columns(table, "MetricName")))[1])
    return reduce(DataFrame.unionByName, sides)


def map_rejects(flat: DataFrame) -> DataFrame:
    """C4 for all types: rejected points, and one reject per nameless metric."""
    rejects = validate(point_heads(flat))[1]
    return rejects.unionByName(nameless_rejects(nameless_metrics(flat)))


def map_requests(requests: DataFrame, ingest_time: datetime | Column) -> dict[str, DataFrame]:
    """Requests to the five point tables, the series rows and the rejects.

    The branches share the flattening. When ``requests`` is a small batch,
    persist it first; over a large Parquet input use ``ingest_files``, where
    each branch reads only the payload it needs.
    """
    flat = flatten_metrics(requests)
    return {
        **{table: slim(map_points(flat, table), table) for table in POINT_TABLES},
        "series": map_series(flat, ingest_time),
        "rejects": map_rejects(flat),
    }
