"""B1: request tree to one row per metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.attributes import (
    attribute_entries_sql,
    entries_to_map_sql,
    service_name_sql,
)
from metricloom.functions.identity import entries_section_sql
from metricloom.schema import POINT_TABLES

RESOURCE_COLUMNS = ["ServiceName", "ResourceAttributes", "ResourceSchemaUrl", "_resource_section"]
SCOPE_COLUMNS = [
    "ScopeName", "ScopeVersion", "ScopeAttributes", "ScopeDroppedAttrCount", "ScopeSchemaUrl",
]
METRIC_COLUMNS = ["MetricName", "MetricDescription", "MetricUnit"]


def flatten_metrics(requests: DataFrame) -> DataFrame:
    """B1: one row per metric, with its resource and scope and its payload columns.

    Resource and scope attributes are turned into maps, and the resource part
    of the canonical key into text, at their own level of the tree: once per
    resource and scope, not once per point. Empty arrays yield no rows. There
    is no shuffle.
    """
    resources = requests.selectExpr("explode(resourceMetrics) as rm").selectExpr(
        f"{service_name_sql('rm.resource.attributes')} as ServiceName",
        f"{attribute_entries_sql('rm.resource.attributes')} as _entries",
        "coalesce(rm.schemaUrl, '') as ResourceSchemaUrl",
        "rm.scopeMetrics as _scopes",
    )
    scopes = resources.selectExpr(
        "ServiceName",
        f"{entries_to_map_sql('_entries')} as ResourceAttributes",
        "ResourceSchemaUrl",
        f"{entries_section_sql('_entries')} as _resource_section",
        "explode(_scopes) as sm",
    ).selectExpr(
        *RESOURCE_COLUMNS,
        "coalesce(sm.scope.name, '') as ScopeName",
        "coalesce(sm.scope.version, '') as ScopeVersion",
        f"{attribute_entries_sql('sm.scope.attributes')} as _entries",
        "coalesce(sm.scope.droppedAttributesCount, 0L) as ScopeDroppedAttrCount",
        "coalesce(sm.schemaUrl, '') as ScopeSchemaUrl",
        "sm.metrics as _metrics",
    )
    metrics = scopes.selectExpr(
        *RESOURCE_COLUMNS,
        *[c for c in SCOPE_COLUMNS if c != "ScopeAttributes"],
        f"{entries_to_map_sql('_entries')} as ScopeAttributes",
        "explode(_metrics) as m",
    )
    present = metrics.schema["m"].dataType.fieldNames()
    return metrics.selectExpr(
        *RESOURCE_COLUMNS,
        *SCOPE_COLUMNS,
        "coalesce(m.name, '') as MetricName",
        "coalesce(m.description, '') as MetricDescription",
        "coalesce(m.unit, '') as MetricUnit",
        *[f"m.{arm} as {arm}" for _, arm, _ in POINT_TABLES.values() if arm in present],
    )


def named_metrics(flat: DataFrame) -> DataFrame:
    """C1, accepted side: metrics that have a name."""
    return flat.filter(F.col("MetricName") != "")


def nameless_metrics(flat: DataFrame) -> DataFrame:
    """C1, rejected side: one row per metric without a name, whatever it holds."""
    return flat.filter(F.col("MetricName") == "")


def route(flat: DataFrame, table: str) -> DataFrame:
    """B2: named metrics that carry the payload of ``table``, labelled with their type.

    A metric without any payload belongs to no table and is not a reject.
    """
    metric_type, arm, _ = POINT_TABLES[table]
    return named_metrics(flat).filter(F.col(arm).isNotNull()).withColumn(
        "MetricType", F.lit(metric_type)
    )
