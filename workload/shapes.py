"""Provided tables -> export requests.

One source row (or one row of an ordinary aggregation) becomes one request, so
no shape ever gathers a group of rows into an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.schema import KEY_VALUES, POINT_TABLES

RESOURCE_URL = "https://example.org/resource/1"
SCOPE_URL = "https://example.org/scope/1"

_KINDS = {
    "stringValue": "string",
    "boolValue": "boolean",
    "intValue": "string",
    "doubleValue": "double",
    "arrayValue": "variant",
    "kvlistValue": "variant",
    "bytesValue": "string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table, dealt over the cores: the files here are one row group each."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism)


def any_value(kind: str | None, sql: str = "null", sparse: bool = False) -> str:
    """SQL of a tagged value with one kind set, or none; if ``sparse``, without the kinds that are not set."""
    fields = [
        f"'{k}', cast({sql if k == kind else 'null'} as {t})"
        for k, t in _KINDS.items()
        if k == kind or not sparse
    ]
    return f"named_struct({', '.join(fields)})"


def attribute(key: str, sql: str, kind: str | None = "stringValue", sparse: bool = False) -> str:
    return f"named_struct('key', '{key}', 'value', {any_value(kind, sql, sparse)})"


def attributes(*items: str) -> str:
    return f"array({', '.join(items)})"


def nanos(timestamp: str) -> str:
    """SQL of the nanoseconds of a zone-less timestamp, as text."""
    micros = f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {timestamp})"
    return f"cast({micros} * 1000 as string)"


def folded(date: str) -> str:
    """SQL nanoseconds, as text, of a date folded into January 2024.

    The date's day number modulo 30 picks the day and the rest the minute, so
    years of orders become one busy month of telemetry and stay distinct.
    """
    number = f"unix_date(cast({date} as date))"
    # 19723 is the day number of 2024-01-01.
    return (
        f"cast((19723L + {number} % 30) * 86400000000000 "
        f"+ ({number} div 30) * 60000000000 as string)"
    )


def number_point(
    attrs: str, time: str, double: str = "null", integer: str = "null", start: str = "null",
    flags: str = "0",
) -> str:
    return (
        f"named_struct('attributes', {attrs}, 'startTimeUnixNano', cast({start} as string), "
        f"'timeUnixNano', {time}, 'flags', cast({flags} as bigint), "
        f"'asDouble', cast({double} as double), 'asInt', cast({integer} as string))"
    )


def distribution_point(attrs: str, time: str, **fields: str) -> str:
    common = (
        f"'attributes', {attrs}, 'startTimeUnixNano', cast(null as string), "
        f"'timeUnixNano', {time}, 'flags', 0L"
    )
    rest = "".join(f", '{name}', {sql}" for name, sql in fields.items())
    return f"named_struct({common}{rest})"


def metric(
    name: str, unit: str = "'1'", description: str = "'shaped from a table'", sparse: bool = False,
    **payload: str,
) -> str:
    """SQL of a metric; ``payload`` maps a payload field to its SQL, others are NULL or, if ``sparse``, left out."""
    arms = "".join(
        f", '{arm}', {payload[arm]}" if sparse else f", '{arm}', cast({payload.get(arm, 'null')} as {ddl})"
        for _, arm, ddl in POINT_TABLES.values()
        if arm in payload or not sparse
    )
    return f"named_struct('name', {name}, 'description', {description}, 'unit', {unit}{arms})"


def gauge(*points: str) -> str:
    return f"named_struct('dataPoints', array({', '.join(points)}))"


def total(*points: str, temporality: int | str = 1, monotonic: str = "true") -> str:
    return (
        f"named_struct('dataPoints', array({', '.join(points)}), "
        f"'aggregationTemporality', {temporality}, 'isMonotonic', {monotonic})"
    )


def distribution(*points: str, temporality: int = 1) -> str:
    return (
        f"named_struct('dataPoints', array({', '.join(points)}), "
        f"'aggregationTemporality', {temporality})"
    )


def request(resource: str, scope: str, *metrics: str, scope_attributes: str | None = None) -> str:
    scope_attributes = scope_attributes or f"cast(array() as {KEY_VALUES})"
    return (
        "array(named_struct("
        f"'resource', named_struct('attributes', {resource}), 'schemaUrl', '{RESOURCE_URL}', "
        "'scopeMetrics', array(named_struct("
        f"'scope', named_struct('name', '{scope}', 'version', '1.0', "
        f"'attributes', {scope_attributes}, 'droppedAttributesCount', 0L), "
        f"'schemaUrl', '{SCOPE_URL}', 'metrics', array({', '.join(metrics)})))))"
        " as resourceMetrics"
    )


def _event_resource(sparse: bool = False) -> str:
    return attributes(
        attribute("service.name", "concat('svc-', user_id % 7)", sparse=sparse),
        attribute("host.name", "concat('h', user_id % 3)", sparse=sparse),
    )


def _event_k(sparse: bool = False) -> str:
    return attribute("k", "get_json_object(props, '$.k')", "intValue", sparse)


def gauge_requests(
    events: DataFrame, description: str = "'shaped from a table'", sparse: bool = False
) -> DataFrame:
    """One gauge point per event."""
    time = nanos("ts")
    point = number_point(
        attributes(_event_k(sparse)), time, "value", start=f"{time} - 1000000000L", flags="event_id % 2"
    )
    return events.selectExpr(
        request(
            _event_resource(sparse),
            "events",
            metric("concat('events.', event_type)", description=description, sparse=sparse, gauge=gauge(point)),
            scope_attributes=attributes(attribute("team", "concat('t', user_id % 7 % 2)", sparse=sparse)),
        )
    )


def reject_requests(events: DataFrame) -> DataFrame:
    """One gauge per event, some without a name, a time or a finite value; the faults overlap."""
    time = f"if(event_id % 97 = 0, '0', {nanos('ts')})"
    value = "if(event_id % 89 = 0, double('NaN'), value)"
    name = "if(event_id % 83 = 0, '', concat('events.', event_type))"
    point = number_point(attributes(_event_k()), time, value)
    return events.selectExpr(
        request(_event_resource(), "events", metric(name, gauge=gauge(point, point)))
    )


def attribute_requests(events: DataFrame) -> DataFrame:
    """One gauge per event with every kind of attribute, duplicate keys and empty keys."""
    point_attributes = attributes(
        attribute("type", "event_type"),
        attribute("id", "event_id", "intValue"),
        attribute("", "'nameless'"),
        attribute("dup", "'first'"),
        attribute("value", "value", "doubleValue"),
        attribute("even", "event_id % 2 = 0", "boolValue"),
        attribute(
            "list",
            "parse_json(concat('{\"values\":[{\"intValue\":\"', user_id, '\"}]}'))",
            "arrayValue",
        ),
        attribute(
            "kv",
            "parse_json(concat('{\"values\":[{\"key\":\"u\",\"value\":{\"intValue\":\"', user_id, '\"}}]}'))",
            "kvlistValue",
        ),
        attribute("raw", "base64(cast(event_type as binary))", "bytesValue"),
        attribute("unset", "null", None),
        f"if(event_id % 3 = 0, {attribute('dup', 'event_id', 'intValue')}, "
        f"{attribute('', 'event_id', 'intValue')})",
    )
    text_name = any_value("stringValue", "concat('s', user_id)")
    named = f"if(user_id % 5 = 0, {any_value('intValue', 'user_id')}, {text_name})"
    resource = attributes(
        f"named_struct('key', 'service.name', 'value', {named})",
        attribute("service.name", "'second'"),
        attribute("", "'nameless'"),
    )
    values = (
        f"case event_id % 3 when 0 then {number_point(point_attributes, nanos('ts'), 'value')} "
        f"when 1 then {number_point(point_attributes, nanos('ts'), integer='event_id')} "
        f"else {number_point(point_attributes, nanos('ts'))} end"
    )
    return events.selectExpr(
        request(resource, "events", metric("concat('events.', event_type)", gauge=gauge(values)))
    )


def sum_requests(lineitem: DataFrame, sparse: bool = False) -> DataFrame:
    """One sum point per line item: deltas, cumulative for returns, and some that may fall."""
    point = number_point(
        attributes(
            attribute("linestatus", "l_linestatus", sparse=sparse),
            attribute("returnflag", "l_returnflag", sparse=sparse),
        ),
        folded("l_shipdate"),
        integer="cast(l_quantity as bigint)",
    )
    return lineitem.selectExpr(
        request(
            attributes(attribute("service.name", "concat('supp-', l_suppkey % 5)", sparse=sparse)),
            "lineitem",
            metric(
                "'lineitem.quantity'",
                "'{item}'",
                sparse=sparse,
                sum=total(
                    point,
                    temporality="if(l_returnflag = 'R', 2, 1)",
                    monotonic="l_returnflag <> 'N'",
                ),
            ),
        )
    )


_CENTS = "cast(round(o_totalprice * 100) as bigint)"


def histogram_requests(orders: DataFrame, sparse: bool = False) -> DataFrame:
    """Order prices per priority and day, in five buckets."""
    bounds = [1e5, 2e5, 3e5, 4e5]
    edges = [None, *bounds, None]
    buckets = []
    for low, high in zip(edges, edges[1:], strict=False):
        tests = [f"o_totalprice > {low}"] if low else []
        tests += [f"o_totalprice <= {high}"] if high else []
        buckets.append(f"cast(count_if({' and '.join(tests)}) as string)")
    groups = orders.groupBy("o_orderpriority", "o_orderdate").agg(
        F.expr("count(*) as n"),
        F.expr(f"sum({_CENTS}) as cents"),
        F.expr("min(o_totalprice) as low"),
        F.expr("max(o_totalprice) as high"),
        F.expr(f"array({', '.join(buckets)}) as buckets"),
    )
    point = distribution_point(
        attributes(attribute("priority", "o_orderpriority", sparse=sparse)),
        folded("o_orderdate"),
        count="cast(n as string)",
        sum="cents / 100D",
        min="low",
        max="high",
        bucketCounts="buckets",
        explicitBounds=f"array({', '.join(f'{b}D' for b in bounds)})",
    )
    return groups.selectExpr(
        request(
            attributes(attribute("service.name", "'orders'", sparse=sparse)),
            "orders",
            metric("'orders.price'", "'usd'", sparse=sparse, histogram=distribution(point)),
        )
    )


def exponential_requests(lineitem: DataFrame, sparse: bool = False) -> DataFrame:
    """Quantities less 20 per return flag and day, at scale -1: bucket i holds (4^i, 4^(i+1)].

    Both sides begin at bucket -1, which holds 1.
    """

    def side(sign: str) -> str:
        counts = [
            f"cast(count_if({sign}(l_quantity - 20) > {4.0**i} and {sign}(l_quantity - 20) <= {4.0 ** (i + 1)})"
            " as string)"
            for i in range(-1, 3)
        ]
        return f"array({', '.join(counts)})"

    groups = lineitem.groupBy("l_returnflag", "l_shipdate").agg(
        F.expr("count(*) as n"),
        F.expr("sum(cast(l_quantity as bigint) - 20) as total"),
        F.expr("count_if(l_quantity = 20) as zeros"),
        F.expr(f"{side('')} as above"),
        F.expr(f"{side('-')} as below"),
    )
    point = distribution_point(
        attributes(attribute("returnflag", "l_returnflag", sparse=sparse)),
        folded("l_shipdate"),
        count="cast(n as string)",
        sum="cast(total as double)",
        min="cast(null as double)",
        max="cast(null as double)",
        scale="-1",
        zeroCount="cast(zeros as string)",
        positive="named_struct('offset', -1, 'bucketCounts', above)",
        negative="named_struct('offset', -1, 'bucketCounts', below)",
    )
    return groups.selectExpr(
        request(
            attributes(attribute("service.name", "'lineitem'", sparse=sparse)),
            "lineitem",
            metric(
                "'lineitem.quantity.exp'",
                sparse=sparse,
                exponentialHistogram=distribution(point, temporality=2),
            ),
        )
    )


def summary_requests(orders: DataFrame, sparse: bool = False) -> DataFrame:
    """Quantiles 0.5 and 0.99 of the price per priority and month."""
    groups = orders.selectExpr(
        "o_orderpriority", "date_trunc('MONTH', o_orderdate) as month", "o_totalprice"
    ).groupBy("o_orderpriority", "month").agg(
        F.expr("count(*) as n"),
        F.expr(f"sum({_CENTS}) as cents"),
        F.expr("percentile_disc(0.5) within group (order by o_totalprice) as middle"),
        F.expr("percentile_disc(0.99) within group (order by o_totalprice) as top"),
    )
    point = distribution_point(
        attributes(attribute("priority", "o_orderpriority", sparse=sparse)),
        folded("month"),
        count="cast(n as string)",
        sum="cents / 100D",
        quantileValues=(
            "array(named_struct('quantile', 0.5D, 'value', middle), "
            "named_struct('quantile', 0.99D, 'value', top))"
        ),
    )
    return groups.selectExpr(
        request(
            attributes(attribute("service.name", "'orders'", sparse=sparse)),
            "orders",
            metric("'orders.price.summary'", "'usd'", sparse=sparse, summary=gauge(point)),
        )
    )


def mixed_requests(orders: DataFrame) -> DataFrame:
    """One request per order that holds a metric of every type, and one of none."""
    attrs = attributes(attribute("status", "o_orderstatus"))
    time = folded("o_orderdate")
    one = {"count": "'1'", "sum": "o_totalprice"}
    extremes = {"min": "o_totalprice", "max": "o_totalprice"}
    buckets = "named_struct('offset', 17, 'bucketCounts', array('1'))"
    number = number_point(attrs, time, "o_totalprice")
    # Every fifth order has two gauge points, every seventh none at all.
    gauges = (
        "named_struct('dataPoints', case when o_orderkey % 7 = 0 then array() "
        f"when o_orderkey % 5 = 0 then array({number}, {number}) else array({number}) end)"
    )
    return orders.selectExpr(
        request(
            attributes(attribute("service.name", "concat('cust-', o_custkey % 11)")),
            "orders",
            metric("'order.price'", gauge=gauges),
            metric("'order.count'", sum=total(number_point(attrs, time, integer="1"))),
            metric(
                "'order.hist'",
                histogram=distribution(
                    distribution_point(
                        attrs, time, **one, **extremes,
                        bucketCounts="array('1', '0')", explicitBounds="array(1e9D)",
                    )
                ),
            ),
            metric(
                "'order.exp'",
                exponentialHistogram=distribution(
                    distribution_point(
                        attrs, time, **one, **extremes,
                        scale="0", zeroCount="'0'", positive=buckets, negative=buckets,
                    )
                ),
            ),
            metric(
                "'order.summary'",
                summary=gauge(
                    distribution_point(
                        attrs, time, **one,
                        quantileValues="array(named_struct('quantile', 0.5D, 'value', o_totalprice))",
                    )
                ),
            ),
            metric("'order.nothing'"),
        )
    )
