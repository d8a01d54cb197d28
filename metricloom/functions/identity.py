"""Canonical series key and its 64-bit fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.common import apply_sql

# ``F.xxhash64`` starts from seed 42 and feeds the hash of each argument to the
# next one as its seed. This BIGINT hashes to 0 under seed 42, so a key that
# follows it is hashed with seed 0, as plain XXH64 does.
_SEED_ZERO = -365884300664092260


def sorted_keys(attributes: Column) -> Column:
    """D3: keys of an attribute map in byte order."""
    return F.sort_array(F.map_keys(attributes))


def entries_section_sql(entries: str) -> str:
    """SQL of the canonical text of entries that are already sorted by key."""
    return f"array_join(transform({entries}, e -> concat(e.key, '=', e.value, char(0))), '')"


def map_section(attributes: Column) -> Column:
    """Canonical text of an attribute map."""
    section = entries_section_sql("sort_array(map_entries(m))")
    return apply_sql(attributes, "m", f"coalesce({section}, '')")


def canonical_key_sql(
    metric_name: str,
    metric_type: str,
    resource_schema_url: str,
    scope_name: str,
    scope_version: str,
    resource_section: str,
    point_section: str,
) -> str:
    """SQL of D1."""
    fields = [metric_name, metric_type, resource_schema_url, scope_name, scope_version]
    closed = ", ".join(f"coalesce({field}, ''), char(0)" for field in fields)
    return f"concat({closed}, {resource_section}, char(0), {point_section})"


def canonical_key(
    metric_name: Column,
    metric_type: Column,
    resource_schema_url: Column,
    scope_name: Column,
    scope_version: Column,
    resource_attributes: Column,
    point_attributes: Column,
) -> Column:
    """The identifying text of a series.

    Five fields, each closed by NUL, then both attribute maps as sorted
    ``key=value`` pairs closed by NUL, with one more NUL between the maps. ``=``
    inside a pair is not escaped, so ``{a=b: c}`` and ``{a: b=c}`` share a key.
    """
    parts = {
        "name": metric_name,
        "type": metric_type,
        "url": resource_schema_url,
        "scope": scope_name,
        "version": scope_version,
        "resource": map_section(resource_attributes),
        "point": map_section(point_attributes),
    }
    fields = F.struct(*[column.alias(name) for name, column in parts.items()])
    return apply_sql(fields, "k", canonical_key_sql(*[f"k.{name}" for name in parts]))


def series_id(key: Column) -> Column:
    """XXH64 (seed 0) of the canonical key, as a signed BIGINT."""
    return F.xxhash64(F.lit(_SEED_ZERO), key)


def series_id_sql(key: str) -> str:
    """SQL of D2."""
    return f"xxhash64({_SEED_ZERO}L, {key})"
