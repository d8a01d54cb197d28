"""Reject reasons and the accepted / rejected split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numbers import is_finite_sql
from metricloom.schema import EMPTY_METRIC_NAME, INVALID_VALUE, ZERO_TIMESTAMP


def point_reason_sql(nanos: str, checked_value: str) -> str:
    """SQL of C2 then C3: the first failure of a point, NULL if it is valid."""
    return (
        f"case when {nanos} = 0 then '{ZERO_TIMESTAMP}' "
        f"when not {is_finite_sql(checked_value)} then '{INVALID_VALUE}' end"
    )


def reject_rows(failed: DataFrame) -> DataFrame:
    """Rows of the rejects table."""
    return failed.select("reason", "MetricName", "MetricType")


def accepted(points: DataFrame) -> DataFrame:
    """C4, accepted side of points that carry a ``reason``."""
    return points.filter(F.col("reason").isNull()).drop("reason")


def validate(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: accepted points and rejects. One reason per reject, first failure wins."""
    return accepted(points), reject_rows(points.filter(F.col("reason").isNotNull()))


def nameless_rejects(nameless: DataFrame) -> DataFrame:
    """One reject per metric without a name."""
    return nameless.select(
        F.lit(EMPTY_METRIC_NAME).alias("reason"),
        "MetricName",
        F.lit(None).cast("string").alias("MetricType"),
    )
