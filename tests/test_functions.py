import random
import struct

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricloom.functions import attributes, common, identity, numbers, quantiles, times
from metricloom.schema import KEY_VALUES
from tests.builders import attrs, kv


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def attribute_list(spark, pairs):
    import json

    rows = spark.createDataFrame([(json.dumps(attrs(pairs)),)], "j string")
    return rows.select(F.from_json("j", KEY_VALUES).alias("a"))


def g_text(x):
    """%g with shortest digits, from Python's shortest repr."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    digits = repr(abs(x))
    sign = "-" if struct.pack(">d", x)[0] & 0x80 else ""
    if x == 0:
        return sign + "0"
    mantissa, _, e = digits.partition("e")
    whole, _, fraction = mantissa.partition(".")
    both = whole + fraction
    significant = both.lstrip("0")
    exponent = int(e or 0) + len(whole) - 1 - (len(both) - len(significant))
    significant = significant.rstrip("0")
    if exponent < -4 or exponent >= 6:
        tail = "." + significant[1:] if len(significant) > 1 else ""
        return f"{sign}{significant[0]}{tail}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return sign + "0." + "0" * (-exponent - 1) + significant
    if len(significant) <= exponent + 1:
        return sign + significant + "0" * (exponent + 1 - len(significant))
    return sign + significant[: exponent + 1] + "." + significant[exponent + 1 :]


# ------------------------------------------------------------------ D1-D3


def test_seed_constant_hashes_to_zero(spark):
    assert one(spark, F.xxhash64(F.lit(identity._SEED_ZERO))) == 0


def test_series_id_is_xxh64_seed_zero(spark):
    texts = ["", "abc", "é" * 40, "x" * 1000, "m\0Gauge\0\0scope\x001.0\0\0", "日本語\0=\0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", identity.series_id(F.col("t")).alias("h")).collect():
        assert row.h == signed(xxhash.xxh64(row.t.encode()).intdigest())
    assert one(spark, identity.series_id(F.lit("abc"))) == 4952883123889572249


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=60))
def test_series_id_parity_property(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", identity.series_id(F.col("t")).alias("h")).collect():
        assert row.h == signed(xxhash.xxh64(row.t.encode()).intdigest())


def key_of(name, kind, url, scope, version, resource, point):
    def literal_map(m):
        if not m:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[F.lit(x) for kv_ in m.items() for x in kv_])

    scalars = [F.lit(x) for x in (name, kind, url, scope, version)]
    return identity.canonical_key(*scalars, literal_map(resource), literal_map(point))


PINNED = (
    "queue.depth", "Sum", "https://example.org/s/2", "broker", "3.1",
    {"service.name": "mailer", "zone": "b-2"}, {"queue": "out", "shard": "17"},
)


def canonical_text(name, kind, url, scope, version, resource, point):
    def pairs(m):
        return "".join(f"{k}={m[k]}\0" for k in sorted(m))

    return "\0".join([name, kind, url, scope, version]) + "\0" + pairs(resource) + "\0" + pairs(point)


def test_pinned_identities(spark):
    for parts in (PINNED, ("up", "Gauge", "", "", "", {}, {}), ("é", "Summary", "u", "s", "", {"a": ""}, {})):
        expected = signed(xxhash.xxh64(canonical_text(*parts).encode()).intdigest())
        assert one(spark, identity.series_id(key_of(*parts))) == expected


def test_identity_is_order_independent_and_sensitive(spark):
    base = one(spark, identity.series_id(key_of(*PINNED)))
    swapped = list(PINNED)
    swapped[5] = {"zone": "b-2", "service.name": "mailer"}
    swapped[6] = {"shard": "17", "queue": "out"}
    assert one(spark, identity.series_id(key_of(*swapped))) == base
    changes = {0: "queue.age", 1: "Gauge", 2: "", 3: "other", 4: "4", 5: {"zone": "b-3"}, 6: {}}
    for position, change in changes.items():
        altered = list(PINNED)
        altered[position] = change
        assert one(spark, identity.series_id(key_of(*altered))) != base


def test_resource_and_point_attributes_are_not_interchangeable(spark):
    a = one(spark, key_of("m", "Gauge", "", "s", "1", {"k": "v"}, {}))
    b = one(spark, key_of("m", "Gauge", "", "s", "1", {}, {"k": "v"}))
    assert a != b


def test_equals_sign_is_ambiguous_on_purpose(spark):
    a = one(spark, key_of("m", "Gauge", "", "s", "1", {}, {"a=b": "c"}))
    b = one(spark, key_of("m", "Gauge", "", "s", "1", {}, {"a": "b=c"}))
    assert a == b


def test_sorted_keys_in_byte_order(spark):
    m = F.create_map(*[F.lit(x) for x in ("b", "1", "a", "2", "B", "3", "é", "4", "z", "5")])
    assert one(spark, identity.sorted_keys(m)) == ["B", "a", "b", "z", "é"]


# ------------------------------------------------------------------ K1-K6


def test_attribute_values_as_text(spark):
    rows = attribute_list(
        spark,
        [
            ("s", "text"), ("i", -5), ("t", True), ("f", False), ("d", 1e6), ("e", ""),
            ("l", {"arrayValue": {"values": [{"stringValue": "x"}, {"intValue": "1"}]}}),
            ("m", {"kvlistValue": {"values": [{"key": "a", "value": {"stringValue": "b"}}]}}),
            ("b", {"bytesValue": "AQI="}), ("n", {}),
        ],
    )
    got = rows.select(attributes.kv_to_map(F.col("a")).alias("m")).first().m
    assert got == {
        "s": "text", "i": "-5", "t": "true", "f": "false", "d": "1e+06", "e": "",
        "l": '{"values":[{"stringValue":"x"},{"intValue":"1"}]}',
        "m": '{"values":[{"key":"a","value":{"stringValue":"b"}}]}',
        "b": "AQI=", "n": "",
    }


def test_duplicate_keys_last_wins_and_empty_keys_go(spark):
    rows = attribute_list(spark, [("a", 1), ("", "x"), ("b", "y"), ("a", 2), ("c", "z"), ("a", 0)])
    got = rows.select(attributes.kv_to_map(F.col("a")).alias("m")).first().m
    assert got == {"a": "0", "b": "y", "c": "z"}
    stripped = rows.select(F.size(attributes.strip_empty_keys(F.col("a"))).alias("n")).first().n
    assert stripped == 5


def test_absent_attribute_list_is_an_empty_map(spark):
    rows = spark.createDataFrame([(None,)], f"a {KEY_VALUES}")
    row = rows.select(
        attributes.kv_to_map(F.col("a")).alias("m"), attributes.service_name(F.col("a")).alias("s")
    ).first()
    assert row.m == {} and row.s == ""


@pytest.mark.parametrize(
    ("pairs", "name"),
    [
        ([("service.name", "first"), ("service.name", "second")], "first"),
        ([("service.name", 7)], ""),
        ([("host", "h")], ""),
        ([], ""),
    ],
)
def test_service_name(spark, pairs, name):
    rows = attribute_list(spark, pairs)
    assert rows.select(attributes.service_name(F.col("a")).alias("s")).first().s == name


def test_map_keys_and_values(spark):
    m = F.create_map(F.lit("a"), F.lit("1"))
    assert one(spark, attributes.attribute_keys(m)) == ["a"]
    assert one(spark, attributes.attribute_values(m)) == ["1"]


# ------------------------------------------------------------------ K2, K8, K9


def doubles():
    rng = random.Random(7)
    values = [
        0.0, -0.0, 1.0, 100000.0, 1e6, 1234567.0, 20.5, 1e-4, 1e-5, 1e21, -2.5e-7, 0.1, 123456.0,
        999999.0, 999999.5, 0.00012345, 5e-324, 1e-323, 2.0**-44, 2e23, 1.66916620567743078e18,
        1.7976931348623157e308, 2.2250738585072014e-308, float("nan"), float("inf"), float("-inf"),
    ]
    for _ in range(6000):
        values.append(struct.unpack(">d", rng.randbytes(8))[0])
        values.append(rng.uniform(-1e7, 1e7))
        values.append(rng.randrange(10**6) / 100)
        # Short decimals of every size, where the JVM most often prints digits too many.
        values.append(float(f"{rng.randrange(1, 10 ** rng.randint(1, 6))}e{rng.randint(-305, 300)}"))
    values += [float(f"{d}e{e}") for e in range(-300, 301) for d in (1, 2, 9.2, 3.7)]
    return values


def test_double_to_g_is_shortest(spark):
    rows = spark.createDataFrame([(x,) for x in doubles()], "x double")
    got = rows.select("x", numbers.double_to_g(F.col("x")).alias("g")).collect()
    wrong = [(r.x, r.g, g_text(r.x)) for r in got if r.g != g_text(r.x)]
    assert not wrong, wrong[:10]


def test_number_value(spark):
    rows = spark.createDataFrame(
        [((1.5, "2"),), ((None, "1234"),), ((None, None),), ((None, str(2**53 + 1)),)],
        "p struct<asDouble:double,asInt:string>",
    )
    got = [r.v for r in rows.select(numbers.number_value(F.col("p")).alias("v")).collect()]
    assert got == [1.5, 1234.0, 0.0, float(2**53)]


def test_column_functions_are_plain_expressions(spark):
    rows = spark.range(1).select(F.col("id").cast("double").alias("v"), F.col("id").alias("n"))
    used = rows.filter(numbers.is_finite(F.col("v"))).select(
        times.nanos_to_timestamp(F.col("n")), times.nanos_to_date(F.col("n"))
    )
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert "transform" not in plan and "lambda" not in plan


def test_is_finite(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.f for r in rows.select(numbers.is_finite(F.col("v")).alias("f")).collect()]
    assert got == [True, False, False, False, True]


# ------------------------------------------------------------------ K7, K11, K12


def test_nanos_to_timestamp_and_date(spark):
    import datetime as dt

    rows = spark.createDataFrame([(1700000000123456789,), (-1,), (0,), (-(2**63),)], "n long")
    got = rows.select(
        F.unix_micros(times.nanos_to_timestamp(F.col("n"))).alias("us"),
        times.nanos_to_date(F.col("n")).alias("d"),
    ).collect()
    assert [r.us for r in got] == [1700000000123456, -1, 0, -9223372036854776]
    assert [r.d for r in got[:3]] == [
        dt.date(2023, 11, 14), dt.date(1969, 12, 31), dt.date(1970, 1, 1),
    ]


def test_day_does_not_depend_on_the_session_zone(spark):
    rows = spark.createDataFrame([(1700000000000000000,)], "n long")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert str(rows.select(times.nanos_to_date(F.col("n")).alias("d")).first().d) == "2023-11-14"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unsigned_64_bits(spark):
    texts = ["0", "9223372036854775807", "9223372036854775808", "18446744073709551615", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wrapped = rows.select("t", common.wrapped_int64(F.col("t")).alias("n"))
    assert [r.n for r in wrapped.collect()] == [0, 2**63 - 1, -(2**63), -1, 0]
    back = wrapped.select(common.unsigned_text(F.col("n")).alias("u")).collect()
    assert [r.u for r in back] == texts[:4] + ["0"]


def test_or_default(spark):
    assert one(spark, common.or_default(F.lit(None).cast("string"), "")) == ""
    assert one(spark, common.or_default(F.lit(3), 0)) == 3


# ------------------------------------------------------------------ B10, B11


def test_quantiles(spark):
    rows = spark.createDataFrame(
        [([(0.5, 10.0), (0.99, None)],), (None,)], "q array<struct<quantile:double,value:double>>"
    ).select(quantiles.quantile_values(F.col("q")).alias("v"))
    first, second = rows.select(*quantiles.split_quantiles(F.col("v"))).collect()
    assert (first[0], first[1]) == ([0.5, 0.99], [10.0, 0.0])
    assert (second[0], second[1]) == ([], [])


def test_kv_builder_shape():
    assert kv("a", 1) == {"key": "a", "value": {"intValue": "1"}}
