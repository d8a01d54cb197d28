"""Schemas of the request tree and of the six stored tables.

Schemas are DDL strings, handed to ``spark.read.schema`` and
``spark.createDataFrame`` as they are. Nothing is ever inferred.
"""

from __future__ import annotations

from collections.abc import Iterable

# Metric type labels, stored and hashed as part of the identity.
GAUGE = "Gauge"
SUM = "Sum"
HISTOGRAM = "Histogram"
EXPONENTIAL_HISTOGRAM = "ExponentialHistogram"
SUMMARY = "Summary"

# Reject reasons.
EMPTY_METRIC_NAME = "empty_metric_name"
ZERO_TIMESTAMP = "zero_timestamp"
INVALID_VALUE = "invalid_value"
UNREADABLE_REQUEST = "unreadable_request"

# Wire names of the request tree (public OTLP/JSON definition).
ANY_VALUE = (
    "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,"
    "arrayValue:variant,kvlistValue:variant,bytesValue:string>"
)
KEY_VALUES = f"array<struct<key:string,value:{ANY_VALUE}>>"
# 64-bit integers are quoted in OTLP/JSON, so they are read as text.
_POINT = f"attributes:{KEY_VALUES},startTimeUnixNano:string,timeUnixNano:string,flags:bigint"
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
NUMBER_POINT = f"struct<{_POINT},asDouble:double,asInt:string>"
HISTOGRAM_POINT = (
    f"struct<{_POINT},count:string,sum:double,min:double,max:double,"
    "bucketCounts:array<string>,explicitBounds:array<double>>"
)
EXPONENTIAL_POINT = (
    f"struct<{_POINT},count:string,sum:double,min:double,max:double,"
    f"scale:int,zeroCount:string,positive:{_BUCKETS},negative:{_BUCKETS}>"
)
SUMMARY_POINT = (
    f"struct<{_POINT},count:string,sum:double,"
    "quantileValues:array<struct<quantile:double,value:double>>>"
)

# Table name -> (metric type label, payload field of the metric, payload type).
POINT_TABLES = {
    "gauge": (GAUGE, "gauge", f"struct<dataPoints:array<{NUMBER_POINT}>>"),
    "sum": (
        SUM,
        "sum",
        f"struct<dataPoints:array<{NUMBER_POINT}>,aggregationTemporality:int,isMonotonic:boolean>",
    ),
    "histogram": (
        HISTOGRAM,
        "histogram",
        f"struct<dataPoints:array<{HISTOGRAM_POINT}>,aggregationTemporality:int>",
    ),
    "exponential_histogram": (
        EXPONENTIAL_HISTOGRAM,
        "exponentialHistogram",
        f"struct<dataPoints:array<{EXPONENTIAL_POINT}>,aggregationTemporality:int>",
    ),
    "summary": (SUMMARY, "summary", f"struct<dataPoints:array<{SUMMARY_POINT}>>"),
}


# Of a payload, what tells that it is there.
_PRESENCE = "struct<dataPoints:array<struct<timeUnixNano:string>>>"
# Of a point, what tells whether it is accepted.
_CHECKED = {t: "asDouble:double,asInt:string" if t in ("gauge", "sum") else "sum:double" for t in POINT_TABLES}


def head_schema(tables: Iterable[str], attributes: bool = True) -> str:
    """Request tree with what series (or, without ``attributes``, rejects) need of the payloads of ``tables``."""
    labels = f"attributes:{KEY_VALUES}," if attributes else ""
    kinds = {t: f"struct<dataPoints:array<struct<{labels}timeUnixNano:string,{_CHECKED[t]}>>>" for t in tables}
    return _request_schema(kinds, attributes)


def request_schema(tables: Iterable[str] = tuple(POINT_TABLES), presence: bool = False) -> str:
    """Request tree holding only the payloads of ``tables``.

    Reading with a narrower schema is how a per-type scan of nested Parquet
    skips the bytes of the other four payloads; with ``presence`` payloads hold only what
    tells that they are there. ``unreadable`` holds the text of
    a JSON request that cannot be parsed, and is NULL otherwise.
    """
    return _request_schema({t: _PRESENCE if presence else POINT_TABLES[t][2] for t in tables})


def _request_schema(kinds: dict[str, str], attributes: bool = True) -> str:
    """Request tree with the payloads of ``kinds``; without ``attributes`` metrics have their names alone."""
    arms = "".join(f",{POINT_TABLES[t][1]}:{kind}" for t, kind in kinds.items())
    if not attributes:
        metric = f"struct<name:string{arms}>"
        return f"resourceMetrics array<struct<scopeMetrics:array<struct<metrics:array<{metric}>>>>>, unreadable string"
    metric = f"struct<name:string,description:string,unit:string{arms}>"
    scope = (
        f"struct<name:string,version:string,attributes:{KEY_VALUES},"
        "droppedAttributesCount:bigint>"
    )
    return (
        "resourceMetrics array<struct<"
        f"resource:struct<attributes:{KEY_VALUES}>,schemaUrl:string,"
        f"scopeMetrics:array<struct<scope:{scope},schemaUrl:string,metrics:array<{metric}>>>>>"
        ", unreadable string"
    )


REQUEST = request_schema()

# Column names of the stored tables.
SERIES = (
    "SeriesID BIGINT, MetricType STRING, ServiceName STRING, MetricName STRING, "
    "MetricDescription STRING, MetricUnit STRING, ResourceAttributes MAP<STRING,STRING>, "
    "ResourceSchemaUrl STRING, ScopeName STRING, ScopeVersion STRING, "
    "ScopeAttributes MAP<STRING,STRING>, ScopeDroppedAttrCount BIGINT, ScopeSchemaUrl STRING, "
    "Attributes MAP<STRING,STRING>, FirstSeen TIMESTAMP, LastSeen TIMESTAMP"
)
_BASE = (
    "SeriesID BIGINT, StartTimeUnixNano BIGINT, StartTimeUnix TIMESTAMP, "
    "TimeUnixNano BIGINT, TimeUnix TIMESTAMP, Flags BIGINT, "
)
POINTS = {
    "gauge": _BASE + "Value DOUBLE",
    "sum": _BASE + "Value DOUBLE, AggregationTemporality INT, IsMonotonic BOOLEAN",
    "histogram": _BASE
    + "Count BIGINT, Sum DOUBLE, BucketCounts ARRAY<BIGINT>, ExplicitBounds ARRAY<DOUBLE>, "
    "Min DOUBLE, Max DOUBLE, AggregationTemporality INT",
    "exponential_histogram": _BASE
    + "Count BIGINT, Sum DOUBLE, Scale INT, ZeroCount BIGINT, PositiveOffset INT, "
    "PositiveBucketCounts ARRAY<BIGINT>, NegativeOffset INT, NegativeBucketCounts ARRAY<BIGINT>, "
    "Min DOUBLE, Max DOUBLE, AggregationTemporality INT",
    "summary": _BASE
    + "Count BIGINT, Sum DOUBLE, ValueAtQuantiles ARRAY<STRUCT<Quantile:DOUBLE,Value:DOUBLE>>",
}
REJECTS = "reason STRING, MetricName STRING, MetricType STRING"
LEDGER = "table STRING, rows BIGINT, duration_ms BIGINT, error STRING"
ZONES = (
    "file STRING, min_id BIGINT, max_id BIGINT, min_nanos BIGINT, max_nanos BIGINT, rows BIGINT"
)
ATTRIBUTE_INDEX = "key STRING, value STRING, SeriesID BIGINT"


def column_names(ddl: str) -> list[str]:
    """Top-level column names of a table schema above."""
    names, depth, start = [], 0, True
    for word in ddl.replace("<", " < ").replace(">", " > ").replace(",", " , ").split():
        if word in "<>":
            depth += 1 if word == "<" else -1
        elif word == "," and depth == 0:
            start = True
        elif start:
            names.append(word)
            start = False
    return names
