"""Small helpers shared by the column functions.

Longer expressions are written as SQL text: one parse in the JVM instead of a
Python-to-JVM call per operator, which keeps building a query cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` inside ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def apply_sql(value: Column, name: str, body: str) -> Column:
    """The SQL expression ``body`` over a column known as ``name`` inside it."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def or_default(value: Column, default: object) -> Column:
    """The zero value of a field that is not set."""
    return F.coalesce(value, F.lit(default))


def wrapped_int64(value: Column) -> Column:
    """Unsigned 64-bit text or number as the signed integer with the same bits; unset is 0.

    Used for times and counts; ``unsigned_text`` reads the bits back.
    """
    return apply_sql(value, "n", wrapped_int64_sql("n"))


def wrapped_int64_sql(n: str) -> str:
    """SQL of ``wrapped_int64``; the wide cast only runs on what is not a signed integer."""
    wide = f"try_cast({n} as decimal(20,0))"
    return (
        f"coalesce(try_cast({n} as bigint), "
        f"if({wide} > 0, try_cast({wide} - 18446744073709551616BD as bigint), null), 0L)"
    )


def counts64_sql(values: str) -> str:
    """SQL of an array of counts as ``wrapped_int64``, unset as the empty array."""
    return (
        f"coalesce(transform({values}, c -> {wrapped_int64_sql('c')}), "
        "cast(array() as array<bigint>))"
    )


def unsigned_text(value: Column) -> Column:
    """Decimal text of a BIGINT read as unsigned 64 bits."""
    wide = value.cast("decimal(20,0)")
    shifted = wide + F.expr("18446744073709551616BD")
    return F.when(value < 0, shifted).otherwise(wide).cast("string")
