"""Summary quantiles."""

from __future__ import annotations

from pyspark.sql import Column

from metricloom.functions.common import apply_sql


def quantile_values(quantiles: Column) -> Column:
    """Wire quantiles to the stored (Quantile, Value) list; unset is empty."""
    return apply_sql(quantiles, "l", quantile_values_sql("l"))


def quantile_values_sql(quantiles: str) -> str:
    """SQL of B10."""
    return (
        f"coalesce(transform({quantiles}, q -> "
        "struct(coalesce(q.quantile, 0D) as Quantile, coalesce(q.value, 0D) as Value)), "
        "cast(array() as array<struct<Quantile:double,Value:double>>))"
    )


def split_quantiles(stored: Column) -> tuple[Column, Column]:
    """The quantiles and the values as two parallel arrays."""
    return stored["Quantile"], stored["Value"]
