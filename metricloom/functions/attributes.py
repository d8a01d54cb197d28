"""Attribute values, lists and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.common import apply_sql, let
from metricloom.functions.numbers import double_to_g_sql

# Fixed value: resource attribute that names the service.
SERVICE_NAME = "service.name"

_COMPLEX = "coalesce(to_json({v}.arrayValue), to_json({v}.kvlistValue), {v}.bytesValue)"
_TEXT = (
    "coalesce({v}.stringValue, cast(try_cast({v}.intValue as bigint) as string), "
    + double_to_g_sql("{v}.doubleValue")
    + ", cast({v}.boolValue as string), "
    + _COMPLEX
    + ", '')"
)
_NAMED = "filter({a}, e -> coalesce(e.key, '') <> '')"
_ENTRY = "struct<key:string,pos:int,value:string>"
# The named entries of a list with their place and text, as they come; NULL for an absent list.
_PAIRS = f"transform({_NAMED}, (e, i) -> struct(e.key as key, i as pos, {_TEXT.format(v='e.value')} as value))"
_LAST = "filter(s, (e, i) -> coalesce(get(s, i + 1).key <> e.key, true))"


def attribute_pairs_sql(attributes: str) -> str:
    """SQL of the first step of ``attribute_entries``: unlike tagged values, its result can be grouped."""
    return _PAIRS.format(a=attributes)


def pairs_to_entries_sql(pairs: str) -> str:
    """SQL of the second step of ``attribute_entries``: sorted by key, last duplicate kept."""
    return f"coalesce({let('s', f'sort_array({pairs})', _LAST)}, cast(array() as array<{_ENTRY}>))"


def attribute_entries_sql(attributes: str) -> str:
    """SQL of ``attribute_entries``."""
    return pairs_to_entries_sql(attribute_pairs_sql(attributes))


def service_name_sql(attributes: str) -> str:
    """SQL of K6."""
    first = f"get(filter({attributes}, e -> e.key = '{SERVICE_NAME}'), 0)"
    return f"coalesce({first}.value.stringValue, '')"


def entries_to_map_sql(entries: str) -> str:
    """SQL map of sorted unique entries; needs no map-key policy in the session."""
    return f"map_from_arrays({entries}.key, {entries}.value)"


def any_value_to_string(value: Column) -> Column:
    """K1: text of a tagged value; an unset one is ''."""
    return apply_sql(value, "v", _TEXT.format(v="v"))


def complex_value_to_string(value: Column) -> Column:
    """K3: JSON text of a list or map value, base64 text of a bytes value."""
    return apply_sql(value, "v", _COMPLEX.format(v="v"))


def strip_empty_keys(attributes: Column) -> Column:
    """K5: the list without entries whose key is empty or missing."""
    return apply_sql(attributes, "a", _NAMED.format(a="a"))


def attribute_entries(attributes: Column) -> Column:
    """K4 and K5: (key, value text) entries sorted by key, last duplicate kept.

    An absent list gives an empty array.
    """
    return apply_sql(attributes, "a", attribute_entries_sql("a"))


def kv_to_map(attributes: Column) -> Column:
    """K4: key/value list to map, last duplicate wins, empty keys stripped."""
    return apply_sql(attribute_entries(attributes), "u", entries_to_map_sql("u"))


def service_name(attributes: Column) -> Column:
    """K6: the first ``service.name`` if it holds a string, else ''."""
    return apply_sql(attributes, "a", service_name_sql("a"))


def attribute_keys(attributes: Column) -> Column:
    """Keys of an attribute map."""
    return F.map_keys(attributes)


def attribute_values(attributes: Column) -> Column:
    """Values of an attribute map."""
    return F.map_values(attributes)
