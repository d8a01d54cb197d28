"""K2, K8, K9: number values and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.common import apply_sql, let


def number_value(point: Column) -> Column:
    """K8: the double if set, else the integer as a double, else 0."""
    whole = point["asInt"].try_cast("bigint").cast("double")
    return F.coalesce(point["asDouble"], whole, F.lit(0.0))


def number_value_sql(point: str) -> str:
    """SQL of K8."""
    return (
        f"coalesce({point}.asDouble, cast(try_cast({point}.asInt as bigint) as double), 0D)"
    )


def is_finite(value: Column) -> Column:
    """K9: neither NaN nor an infinity."""
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_finite_sql(x: str) -> str:
    """SQL of K9."""
    return f"(not isnan({x}) and abs({x}) < double('Infinity'))"


def double_to_g(value: Column) -> Column:
    """K2: shortest text that reads back as the same double, laid out as ``%g``.

    Scientific form is used for decimal exponents below -4 and from 6 on.
    """
    return apply_sql(value, "x", double_to_g_sql("x"))


def double_to_g_sql(x: str) -> str:
    """SQL of K2 over the double ``x``, which should be a plain name or field."""
    sign = f"if(startswith(cast({x} as string), '-'), '-', '')"
    finite = let("g", _shortest_sql(f"abs({x})"), f"concat({sign}, {_LAYOUT})")
    return (
        f"case when {x} is null then null when isnan({x}) then 'NaN' "
        f"when {x} = double('Infinity') then '+Inf' when {x} = double('-Infinity') then '-Inf' "
        f"when {x} = 0 then concat({sign}, '0') else {finite} end"
    )


# How many digits to try without, each rounded to both sides.
_DROPPED = ", ".join(f"{k}, {k}" for k in range(8, 0, -1))


def _shortest_sql(magnitude: str) -> str:
    """Struct of significant digits and decimal exponent of a positive double."""
    # Digits and exponent as the JVM prints them, such as 1.234E-5.
    printed = let(
        "t",
        f"cast({magnitude} as string)",
        let(
            "m",
            "substring_index(t, 'E', 1)",
            "struct(replace(m, '.', '') as padded, length(substring_index(m, '.', 1)) - 1 "
            "+ if(contains(t, 'E'), cast(substring_index(t, 'E', -1) as int), 0) as power)",
        ),
    )
    # Between 2**53 and 2**63 a double is an integer, whose digits are exact.
    exact = (
        f"struct(cast(cast({magnitude} as bigint) as string) as padded, "
        f"length(cast(cast({magnitude} as bigint) as string)) - 1 as power)"
    )
    printed = f"if({magnitude} >= 9.1e15 and {magnitude} < 9.2e18, {exact}, {printed})"
    trimmed = let(
        "p",
        printed,
        "struct(trim(both '0' from p.padded) as digits, "
        "p.power - length(p.padded) + length(trim(leading '0' from p.padded)) as exponent)",
    )
    # From 16 digits on, and at the low end of its range, the JVM may print a few
    # digits more than needed.
    # Take the shortest prefix, rounded to the nearer side first, that reads back equal.
    number = (
        "cast(substr(d.digits, 1, length(d.digits) - k) as bigint) "
        "+ if((i % 2 = 0) = (substr(d.digits, length(d.digits) - k + 1, 1) >= '5'), 1, 0)"
    )
    candidates = (
        f"transform(filter(array({_DROPPED}), k -> k < length(d.digits)), (k, i) -> "
        f"struct(cast({number} as string) as number, length(d.digits) - k as kept))"
    )
    equal = (
        "filter(" + candidates + ", c -> try_cast(concat(c.number, 'e', "
        f"d.exponent - c.kept + 1) as double) = {magnitude})"
    )
    shortened = let(
        "c",
        f"get({equal}, 0)",
        "if(c is null, d, struct(trim(trailing '0' from c.number) as digits, "
        "d.exponent + length(c.number) - c.kept as exponent))",
    )
    return let("d", trimmed, f"if(length(d.digits) >= 16 or {magnitude} < 1e-300, {shortened}, d)")


_LAYOUT = (
    "case when g.exponent < -4 or g.exponent >= 6 then concat(left(g.digits, 1), "
    "if(length(g.digits) > 1, concat('.', substr(g.digits, 2)), ''), "
    "if(g.exponent < 0, 'e-', 'e+'), lpad(abs(g.exponent), "
    "greatest(2, length(abs(g.exponent))), '0')) "
    "when g.exponent < 0 then concat('0.', repeat('0', -1 - g.exponent), g.digits) "
    "when length(g.digits) <= g.exponent + 1 then rpad(g.digits, g.exponent + 1, '0') "
    "else concat(left(g.digits, g.exponent + 1), '.', substr(g.digits, g.exponent + 2)) end"
)
