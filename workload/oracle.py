"""SQL answers of the queries, stated directly on the provided tables (DuckDB)."""

from __future__ import annotations

# ---------------------------------------------------------------- inputs

_N = "chr(0)"


def _key(name: str, kind: str, scope: str, resource: str, point: str) -> str:
    """Canonical key; ``resource`` and ``point`` are lists of SQL pairs."""
    parts = [name, f"'{kind}'", "'https://example.org/resource/1'", f"'{scope}'", "'1.0'"]
    text = f" || {_N} || ".join(parts) + f" || {_N}"
    for pair in resource:
        text += f" || {pair} || {_N}"
    text += f" || {_N}"
    for pair in point:
        text += f" || {pair} || {_N}"
    return text


_EV_KEY = _key(
    "'events.' || event_type", "Gauge", "events",
    ["'host.name=h' || (user_id % 3)", "'service.name=svc-' || (user_id % 7)"],
    ["'k=' || regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)"],
)


def _folded(date: str) -> str:
    number = f"date_diff('day', DATE '1970-01-01', CAST({date} AS DATE))"
    return f"(19723 + {number} % 30) * 86400000000000 + ({number} // 30) * 60000000000"


EV = f"""ev AS (
  SELECT event_id, 'events.' || event_type AS metric, 'svc-' || (user_id % 7) AS svc,
    'h' || (user_id % 3) AS host, 't' || (user_id % 7 % 2) AS team,
    regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS k,
    epoch_us(ts) * 1000 AS nanos, value, event_id % 2 AS flags, event_id % 2 AS part, ts,
    {_EV_KEY} AS key
  FROM events)"""
_LI_KEY = _key(
    "'lineitem.quantity'", "Sum", "lineitem", ["'service.name=supp-' || (l_suppkey % 5)"],
    ["'linestatus=' || l_linestatus", "'returnflag=' || l_returnflag"],
)
LI = f"""li AS (
  SELECT 'supp-' || (l_suppkey % 5) AS svc, l_returnflag AS rf, l_linestatus AS ls,
    {_folded('l_shipdate')} AS nanos, l_shipdate, l_quantity AS value,
    day(l_shipdate) % 2 AS part, {_LI_KEY} AS key
  FROM lineitem)"""
_HI_KEY = _key(
    "'orders.price'", "Histogram", "orders", ["'service.name=orders'"],
    ["'priority=' || o_orderpriority"],
)
HI = f"""hi AS (
  SELECT o_orderpriority AS pri, o_orderdate AS d, {_folded('o_orderdate')} AS nanos,
    day(o_orderdate) % 2 AS part, {_HI_KEY} AS key, count(*) AS n,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total,
    min(o_totalprice) AS low, max(o_totalprice) AS high,
    count(*) FILTER (o_totalprice <= 100000) || ',' ||
    count(*) FILTER (o_totalprice > 100000 AND o_totalprice <= 200000) || ',' ||
    count(*) FILTER (o_totalprice > 200000 AND o_totalprice <= 300000) || ',' ||
    count(*) FILTER (o_totalprice > 300000 AND o_totalprice <= 400000) || ',' ||
    count(*) FILTER (o_totalprice > 400000) AS buckets
  FROM orders GROUP BY o_orderpriority, o_orderdate)"""
_EX_KEY = _key(
    "'lineitem.quantity.exp'", "ExponentialHistogram", "lineitem", ["'service.name=lineitem'"],
    ["'returnflag=' || l_returnflag"],
)


def _ex_side(sign: str) -> str:
    return " || ',' || ".join(
        f"count(*) FILTER ({sign}(l_quantity - 20) > {4.0**i} AND {sign}(l_quantity - 20) <= {4.0 ** (i + 1)})"
        for i in range(-1, 3)
    )


EX = f"""ex AS (
  SELECT l_returnflag AS rf, l_shipdate AS d, {_folded('l_shipdate')} AS nanos,
    day(l_shipdate) % 2 AS part, {_EX_KEY} AS key, count(*) AS n,
    CAST(sum(CAST(l_quantity AS BIGINT) - 20) AS DOUBLE) AS total,
    count(*) FILTER (l_quantity = 20) AS zeros, {_ex_side('')} AS above, {_ex_side('-')} AS below
  FROM lineitem GROUP BY l_returnflag, l_shipdate)"""
_SU_KEY = _key(
    "'orders.price.summary'", "Summary", "orders", ["'service.name=orders'"], ["'priority=' || pri"]
)
SU = f"""su AS (
  SELECT pri, m, {_folded('m')} AS nanos, month(m) % 2 AS part, {_SU_KEY} AS key,
    count(*) AS n, CAST(sum(cents) AS DOUBLE) / 100 AS total,
    quantile_disc(price, 0.5) AS low, quantile_disc(price, 0.99) AS high
  FROM (SELECT o_orderpriority AS pri, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m,
          CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_totalprice AS price FROM orders)
  GROUP BY pri, m)"""
ALL = f"""WITH {EV}, {LI}, {HI}, {EX}, {SU}, pts AS (
  SELECT 'gauge' AS tbl, 'Gauge' AS kind, metric, svc, part, key FROM ev
  UNION ALL SELECT 'sum', 'Sum', 'lineitem.quantity', svc, part, key FROM li
  UNION ALL SELECT 'histogram', 'Histogram', 'orders.price', 'orders', part, key FROM hi
  UNION ALL SELECT 'exponential_histogram', 'ExponentialHistogram', 'lineitem.quantity.exp',
    'lineitem', part, key FROM ex
  UNION ALL SELECT 'summary', 'Summary', 'orders.price.summary', 'orders', part, key FROM su)
"""
RJ = """rj AS (
  SELECT 'events.' || event_type AS metric, epoch_us(ts) * 1000 AS nanos, copy.c,
    CASE WHEN event_id % 83 = 0 THEN 'empty_metric_name' WHEN event_id % 97 = 0 THEN 'zero_timestamp'
         WHEN event_id % 89 = 0 THEN 'invalid_value' END AS reason,
    event_id % 83 = 0 AS nameless, event_id % 89 = 0 AS nan
  FROM events, (VALUES (1), (2)) AS copy(c))"""
# Gauge points of an order of the mixed shape.
MX = """mx AS (
  SELECT 'cust-' || (o_custkey % 11) AS svc, o_orderstatus AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS gauges
  FROM orders)"""
_RANGE = (
    "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"
)
_CUT = "ts < TIMESTAMP '2024-01-16 00:00:00'"

_DAY = "CAST(CAST(make_timestamp(nanos // 1000) AS DATE) AS VARCHAR) AS day"
_VALUES = {
    "gauge": (
        EV,
        f"nanos AS \"TimeUnixNano\", {_DAY}, value AS \"Value\", "
        'nanos - 1000000000 AS "StartTimeUnixNano", flags AS "Flags" FROM ev',
    ),
    "sum": (
        LI,
        f"nanos AS \"TimeUnixNano\", {_DAY}, value AS \"Value\", "
        'CASE rf WHEN \'R\' THEN 2 ELSE 1 END AS "AggregationTemporality", '
        'rf <> \'N\' AS "IsMonotonic" FROM li',
    ),
    "histogram": (
        HI,
        f"nanos AS \"TimeUnixNano\", {_DAY}, n AS \"Count\", total AS \"Sum\", buckets, "
        '\'100000.0,200000.0,300000.0,400000.0\' AS bounds, low AS "Min", high AS "Max", 1 AS "AggregationTemporality" FROM hi',
    ),
    "exponential_histogram": (
        EX,
        f"nanos AS \"TimeUnixNano\", {_DAY}, n AS \"Count\", total AS \"Sum\", -1 AS \"Scale\", "
        'zeros AS "ZeroCount", -1 AS "PositiveOffset", above AS buckets, -1 AS "NegativeOffset", '
        'below AS negatives, CAST(0 AS DOUBLE) AS "Min", CAST(0 AS DOUBLE) AS "Max", '
        '2 AS "AggregationTemporality" FROM ex',
    ),
    "summary": (
        SU,
        f"nanos AS \"TimeUnixNano\", {_DAY}, n AS \"Count\", total AS \"Sum\", low, high, "
        "CAST(0.99 AS DOUBLE) AS top FROM su",
    ),
}
_METADATA = {
    "gauge": "metric AS \"MetricName\", '1' AS \"MetricUnit\", svc AS \"ServiceName\"",
    "sum": "'lineitem.quantity' AS \"MetricName\", '{item}' AS \"MetricUnit\", svc AS \"ServiceName\"",
    "histogram": "'orders.price' AS \"MetricName\", 'usd' AS \"MetricUnit\", 'orders' AS \"ServiceName\"",
    "exponential_histogram": "'lineitem.quantity.exp' AS \"MetricName\", '1' AS \"MetricUnit\", "
    "'lineitem' AS \"ServiceName\"",
    "summary": "'orders.price.summary' AS \"MetricName\", 'usd' AS \"MetricUnit\", "
    "'orders' AS \"ServiceName\"",
}


def _stored(table: str) -> str:
    cte, select = _VALUES[table]
    return f"WITH {cte} SELECT {select}"


def _mapped(table: str) -> str:
    cte, select = _VALUES[table]
    return f"WITH {cte} SELECT {_METADATA[table]}, md5(key) AS series_key, {select}"


def g_text(x: str) -> str:
    """Shortest %g text of the double ``x`` (finite, not 0)."""
    text = f"CAST(abs({x}) AS VARCHAR)"
    mantissa = f"split_part({text}, 'e', 1)"
    power = f"coalesce(TRY_CAST(nullif(split_part({text}, 'e', 2), '') AS INTEGER), 0)"
    padded = f"replace({mantissa}, '.', '')"
    digits = f"trim({padded}, '0')"
    exponent = (
        f"({power} + length(split_part({mantissa}, '.', 1)) - 1 "
        f"- (length({padded}) - length(ltrim({padded}, '0'))))"
    )
    scientific = (
        f"{digits}[1] || CASE WHEN length({digits}) > 1 THEN '.' || {digits}[2:] ELSE '' END || 'e' "
        f"|| CASE WHEN {exponent} < 0 THEN '-' ELSE '+' END "
        f"|| CASE WHEN abs({exponent}) < 10 THEN '0' ELSE '' END || abs({exponent})"
    )
    return (
        f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE "
        f"WHEN {exponent} < -4 OR {exponent} >= 6 THEN {scientific} "
        f"WHEN {exponent} < 0 THEN '0.' || repeat('0', CAST(-1 - {exponent} AS INTEGER)) || {digits} "
        f"WHEN length({digits}) <= {exponent} + 1 THEN rpad({digits}, CAST({exponent} + 1 AS INTEGER), '0') "
        f"ELSE {digits}[1:{exponent} + 1] || '.' || {digits}[{exponent} + 2:] END"
    )


_REPORT = f"""{ALL} SELECT tbl AS "table", count(*) AS points, count(DISTINCT key) AS series,
  CAST(0 AS BIGINT) AS orphans FROM pts GROUP BY tbl"""
_ROWS = f"""{ALL} SELECT tbl AS "table", count(*) AS rows FROM pts GROUP BY tbl
  UNION ALL SELECT 'series', count(DISTINCT key) FROM pts"""
_SERIES = """SELECT DISTINCT md5(key) AS series_key, metric AS "MetricName",
  svc AS "ServiceName\""""
_DESCRIBED = """SELECT DISTINCT md5(key) AS series_key, metric AS "MetricName",
  svc AS "ServiceName", 'k=' || k AS attrs FROM ev"""
_NANOS = "epoch_us(ts) * 1000 AS nanos"
# Attribute values of the attribute shape, as (key, text); position keeps duplicates apart.
_ATTRS = f"""
  SELECT {_NANOS}, 'type' AS key, event_type AS text FROM events
  UNION ALL SELECT {_NANOS}, 'id', CAST(event_id AS VARCHAR) FROM events
  UNION ALL SELECT {_NANOS}, '', 'nameless' FROM events
  UNION ALL SELECT {_NANOS}, 'dup', 'first' FROM events
  UNION ALL SELECT {_NANOS}, 'value', {g_text('value')} FROM events
  UNION ALL SELECT {_NANOS}, 'even', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM events
  UNION ALL SELECT {_NANOS}, 'raw', base64(encode(event_type)) FROM events
  UNION ALL SELECT {_NANOS}, 'unset', '' FROM events
  UNION ALL SELECT {_NANOS}, CASE WHEN event_id % 3 = 0 THEN 'dup' ELSE '' END,
    CAST(event_id AS VARCHAR) FROM events"""
_LIST = """'{"values":[{"intValue":"' || user_id || '"}]}'"""
_KV = """'{"values":[{"key":"u","value":{"intValue":"' || user_id || '"}}]}'"""
_ATTR_KEY = (
    f"'events.' || event_type || {_N} || 'Gauge' || {_N} || 'https://example.org/resource/1' || {_N} "
    f"|| 'events' || {_N} || '1.0' || {_N} || 'service.name=second' || {_N} || {_N} "
    f"|| 'dup=' || CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'first' END || {_N} "
    f"|| 'even=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || {_N} "
    f"|| 'id=' || event_id || {_N} || 'kv=' || {_KV} || {_N} || 'list=' || {_LIST} || {_N} "
    f"|| 'raw=' || base64(encode(event_type)) || {_N} || 'type=' || event_type || {_N} "
    f"|| 'unset=' || {_N} || 'value=' || {g_text('value')} || {_N}"
)
_LATEST = """SELECT md5(key) AS series_key, 'v' || event_id AS "MetricDescription",
    CAST({first} AS BIGINT) AS first_seen, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS last_seen
  FROM (SELECT *, row_number() OVER (PARTITION BY key
            ORDER BY date_trunc('second', ts) DESC, event_id DESC) AS rn,
          min(ts) OVER (PARTITION BY key) AS first_ts FROM ev) WHERE rn = 1"""

ORACLE: dict[str, str] = {
    "a1_read_requests": f"""WITH {EV} SELECT metric AS "MetricName", svc AS "ServiceName",
        nanos AS "TimeUnixNano", value AS "Value", flags AS "Flags" FROM ev""",
    "a2_stream_requests": f"""WITH {EV} SELECT metric AS "MetricName", nanos AS "TimeUnixNano",
        value AS "Value" FROM ev""",
    "a3_scan_series": f"""{ALL} SELECT kind AS "MetricType", metric AS "MetricName",
        svc AS "ServiceName", count(DISTINCT key) AS series FROM pts GROUP BY ALL""",
    "a4_scan_gauge": _stored("gauge"),
    "a5_scan_sum": _stored("sum"),
    "a6_scan_histogram": _stored("histogram"),
    "a7_scan_exponential_histogram": _stored("exponential_histogram"),
    "a8_scan_summary": _stored("summary"),
    "b1_flatten_metrics": f"""WITH {MX} SELECT svc AS "ServiceName", 'orders' AS "ScopeName",
        '1.0' AS "ScopeVersion", m AS "MetricName", '1' AS "MetricUnit", count(*) AS metrics
        FROM mx, (VALUES ('order.price'), ('order.count'), ('order.hist'), ('order.exp'),
          ('order.summary'), ('order.nothing')) AS names(m) GROUP BY svc, m""",
    "b2_route": """SELECT kind AS "MetricType", m AS "MetricName", count(*) AS metrics
        FROM orders, (VALUES ('Gauge', 'order.price'), ('Sum', 'order.count'),
          ('Histogram', 'order.hist'), ('ExponentialHistogram', 'order.exp'),
          ('Summary', 'order.summary')) AS names(kind, m) GROUP BY kind, m""",
    "b3_map_gauge": _mapped("gauge"),
    "b4_map_sum": _mapped("sum"),
    "b5_map_histogram": _mapped("histogram"),
    "b6_map_exponential_histogram": _mapped("exponential_histogram"),
    "b7_map_summary": _mapped("summary"),
    "b8_series_rows": f"""WITH {EV} SELECT md5(key) AS series_key, 'Gauge' AS "MetricType",
        metric AS "MetricName", svc AS "ServiceName", 'team=' || team AS scope,
        'https://example.org/scope/1' AS "ScopeSchemaUrl",
        CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) AS first_seen,
        CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) AS last_seen FROM ev""",
    "b9_slim": f"""WITH {LI} SELECT {_VALUES['sum'][1].removesuffix(' FROM li')}, 10 AS columns
        FROM li""",
    "b10_quantile_values": f"""WITH {SU} SELECT nanos, CAST(0.5 AS DOUBLE) AS quantile, low AS value
        FROM su UNION ALL SELECT nanos, CAST(0.99 AS DOUBLE), high FROM su""",
    "b11_split_quantiles": f"""WITH {SU} SELECT nanos AS "TimeUnixNano", 2 AS levels,
        CAST(0.99 AS DOUBLE) AS top, low, high FROM su""",
    "b12_map_requests": f"""WITH {MX} SELECT 'gauge' AS "table", CAST(sum(gauges) AS BIGINT) AS rows
        FROM mx UNION ALL SELECT t, count(*) FROM mx, (VALUES ('sum'), ('histogram'),
          ('exponential_histogram'), ('summary')) AS n(t) GROUP BY t
        UNION ALL SELECT 'series', CAST(sum(gauges + 4) AS BIGINT) FROM mx""",
    "c1_empty_metric_name": """SELECT CASE WHEN event_id % 83 = 0 THEN 'empty_metric_name' ELSE '' END
        AS reason, event_id % 83 = 0 AS rejected, count(*) AS metrics FROM events GROUP BY ALL""",
    "c2_zero_timestamp": f"""WITH {RJ} SELECT metric AS "MetricName",
        count(*) FILTER (reason = 'zero_timestamp') AS zero, count(*) AS points
        FROM rj WHERE NOT nameless GROUP BY metric""",
    "c3_invalid_value": f"""WITH {RJ} SELECT metric AS "MetricName",
        count(*) FILTER (reason = 'invalid_value') AS invalid, count(*) FILTER (nan) AS nan
        FROM rj WHERE NOT nameless GROUP BY metric""",
    "c4_validate": f"""WITH {RJ} SELECT metric AS "MetricName", coalesce(reason, 'accepted') AS outcome,
        count(*) AS points FROM rj WHERE NOT nameless GROUP BY ALL""",
    "c5_where_metric": f"WITH {EV} {_DESCRIBED} WHERE metric = 'events.click'",
    "c6_where_series": f"""WITH {EV} SELECT nanos AS "TimeUnixNano", value AS "Value" FROM ev
        WHERE metric = 'events.click' AND k = '42'""",
    "c7_time_range": f"""WITH {EV} SELECT nanos AS "TimeUnixNano", value AS "Value", flags AS "Flags"
        FROM ev WHERE {_RANGE}""",
    "c8_where_attribute": f"""WITH {EV}, {LI}, last AS (
          SELECT key, metric, host, arg_max(team, (part, 0)) AS team FROM ev GROUP BY ALL)
        SELECT 'value' AS "by", metric AS "MetricName", count(DISTINCT key) AS series FROM ev
          WHERE host = 'h1' GROUP BY metric
        UNION ALL SELECT 'key', 'lineitem.quantity', count(DISTINCT key) FROM li
        UNION ALL SELECT 'key', 'lineitem.quantity.exp', count(DISTINCT l_returnflag) FROM lineitem
        UNION ALL SELECT 'scope', metric, count(*) FROM last WHERE team = 't1' GROUP BY metric""",
    "c9_where_service": f"WITH {EV} {_DESCRIBED} WHERE svc = 'svc-3'",
    "d1_canonical_key": f"""SELECT epoch_us(ts) * 1000 AS "TimeUnixNano", md5({_ATTR_KEY}) AS series_key,
        CAST(length({_ATTR_KEY}) AS INTEGER) AS key_length FROM events""",
    "d2_series_id": f"""{ALL} SELECT metric AS "MetricName", count(DISTINCT key) AS ids,
        CAST(0 AS BIGINT) AS collisions, count(*) AS points FROM pts WHERE tbl IN ('gauge', 'sum')
        GROUP BY metric""",
    "d3_sorted_keys": f"""SELECT {_NANOS}, 'dup,even,id,kv,list,raw,type,unset,value' AS keys FROM events""",
    "e1_distinct_series": f"WITH {EV} {_SERIES} FROM ev",
    "e2_new_series": f"""WITH {EV} {_SERIES} FROM ev WHERE NOT ({_CUT}) AND NOT EXISTS (
        SELECT 1 FROM ev AS old WHERE old.key = ev.key AND old.{_CUT})""",
    "e2s_new_series_stream": f"WITH {EV} {_SERIES} FROM ev",
    "e2s_store_new_series": f"WITH {EV} {_SERIES} FROM ev",
    "e3_compact_series": f"WITH {EV} " + _LATEST.format(first="epoch(date_trunc('second', ts))"),
    "e3b_compact_series_first_seen": f"WITH {EV} "
    + _LATEST.format(first="epoch(date_trunc('second', first_ts))"),
    "f1_enrich_gauge": f"""WITH {EV} SELECT metric AS "MetricName", svc AS "ServiceName",
        'k=' || k AS attrs, nanos AS "TimeUnixNano", value AS "Value" FROM ev""",
    "f1_enrich_sum": f"""WITH {LI} SELECT 'lineitem.quantity' AS "MetricName",
        '{{item}}' AS "MetricUnit", svc AS "ServiceName",
        'linestatus=' || ls || ';returnflag=' || rf AS attrs, nanos AS "TimeUnixNano",
        value AS "Value" FROM li""",
    "f2_orphans": f"""WITH {EV} SELECT metric AS "MetricName", nanos AS "TimeUnixNano",
        value AS "Value" FROM ev WHERE NOT EXISTS (
          SELECT 1 FROM ev AS s WHERE s.key = ev.key AND s.svc <> 'svc-3')""",
    "f3_points_where": f"""WITH {EV} SELECT nanos AS "TimeUnixNano", value AS "Value" FROM ev
        WHERE host = 'h1'""",
    "f4_series_over_time": f"""WITH {EV} SELECT nanos AS "TimeUnixNano", value AS "Value" FROM ev
        WHERE metric = 'events.click' AND k = '42' AND {_RANGE}""",
    "g1_count_series": f"""WITH {EV} SELECT count(DISTINCT key) AS series FROM ev
        WHERE metric = 'events.click'""",
    "g2_count_points": f"WITH {EV} SELECT count(*) AS points FROM ev WHERE metric = 'events.click'",
    "g3_count_all": "SELECT count(*) AS points FROM lineitem",
    "g4_processed_by_type": f"""WITH {MX} SELECT 'Gauge' AS "MetricType",
        CAST(sum(gauges) AS BIGINT) AS points FROM mx HAVING sum(gauges) > 0
        UNION ALL SELECT t, count(*) FROM mx, (VALUES ('Sum'), ('Histogram'),
          ('ExponentialHistogram'), ('Summary')) AS n(t) GROUP BY t""",
    "g5_skipped_by_reason": f"""WITH {RJ} SELECT reason, count(*) AS rejects FROM rj
        WHERE reason IS NOT NULL AND (NOT nameless OR c = 1) GROUP BY reason""",
    "g6_series_hit_miss": f"""WITH {EV}, seen AS (
          SELECT key, count(*) AS n, (key IN (SELECT key FROM ev WHERE {_CUT})) AS known
          FROM ev WHERE NOT ({_CUT}) GROUP BY key)
        SELECT CAST(sum(n) - count(*) FILTER (NOT known) AS BIGINT) AS hits,
          count(*) FILTER (NOT known) AS misses FROM seen""",
    "g7_requests_received": f"{ALL} SELECT count(*) AS requests FROM pts",
    "g8_batch_sizes": f"""{ALL}, first AS (SELECT key, min(part) AS part FROM pts GROUP BY key)
        SELECT part AS batch_id, tbl AS "table", count(*) AS rows FROM pts GROUP BY ALL
        UNION ALL SELECT part, 'series', count(*) FROM first GROUP BY part""",
    "g9_write_stats": f"""{ALL} SELECT tbl AS "table", CAST(2 AS BIGINT) AS writes,
          CAST(0 AS BIGINT) AS failures, count(*) AS rows, true AS times_fit FROM pts GROUP BY tbl
        UNION ALL SELECT 'series', 2, 0, count(DISTINCT key), true FROM pts""",
    "h1_write_series": f"WITH {EV} {_DESCRIBED}",
    "h2_write_gauge": _stored("gauge"),
    "h3_write_sum": _stored("sum"),
    "h4_write_histogram": _stored("histogram"),
    "h5_write_exponential_histogram": _stored("exponential_histogram"),
    "h6_write_summary": _stored("summary"),
    "h7_physical_layout": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS folder, count(*) AS points,
        CAST(0 AS BIGINT) AS misplaced FROM events GROUP BY 1""",
    "h7_merge_points": _stored("gauge"),
    "h7_batch_below_a_merge": _stored("gauge"),
    "h8_create_tables": _ROWS,
    "h9_empty_batch": f"""WITH {RJ} SELECT 'rejects' AS "table", count(*) AS rows FROM rj
        WHERE reason IS NOT NULL AND NOT nameless""",
    "h10_optimize_series": f"""WITH {EV} SELECT 'before' AS state,
          count(DISTINCT (key, {_CUT})) AS rows FROM ev
        UNION ALL SELECT 'after', count(DISTINCT key) FROM ev""",
    "i1_bloom_lookup": f"""WITH {EV} SELECT metric AS "MetricName", svc AS "ServiceName",
        count(DISTINCT key) AS series FROM ev WHERE metric = 'events.click' AND svc = 'svc-3'
        GROUP BY ALL""",
    "i2_attribute_index": f"""WITH {EV}, {LI}, last AS (
          SELECT key, arg_max(team, (part, 0)) AS team FROM ev GROUP BY key), idx AS (
          SELECT 'resource' AS scope, 'host.name' AS k, host AS v, key FROM ev
          UNION SELECT 'resource', 'service.name', svc, key FROM ev
          UNION SELECT 'scope', 'team', team, key FROM last
          UNION SELECT 'point', 'k', k, key FROM ev
          UNION SELECT 'resource', 'service.name', svc, key FROM li
          UNION SELECT 'point', 'linestatus', ls, key FROM li
          UNION SELECT 'point', 'returnflag', rf, key FROM li
          UNION SELECT 'resource', 'service.name', 'lineitem', 'exp' || l_returnflag FROM lineitem
          UNION SELECT 'point', 'returnflag', l_returnflag, 'exp' || l_returnflag FROM lineitem
          UNION SELECT 'resource', 'service.name', 'orders', 'hist' || o_orderpriority FROM orders
          UNION SELECT 'point', 'priority', o_orderpriority, 'hist' || o_orderpriority FROM orders
          UNION SELECT 'resource', 'service.name', 'orders', 'summary' || o_orderpriority FROM orders
          UNION SELECT 'point', 'priority', o_orderpriority, 'summary' || o_orderpriority FROM orders)
        SELECT scope, k AS key, v AS value, count(*) AS series FROM idx GROUP BY ALL""",
    "i2_points_by_index": f"""WITH {EV} SELECT nanos AS "TimeUnixNano", value AS "Value" FROM ev
        WHERE host = 'h1'""",
    "j1_j2_continuous_ingest": _REPORT,
    "j3_j4_drain_in_capped_batches": _REPORT,
    "j1_two_streams": _REPORT,
    "j3_row_bounded": f"{ALL} SELECT count(*) AS points, CAST(0 AS BIGINT) AS above FROM pts",
    "j5_replayed_batch": _REPORT,
    "k1_any_value_to_string": f"""SELECT * FROM ({_ATTRS})
        UNION ALL SELECT {_NANOS}, 'list', {_LIST} FROM events
        UNION ALL SELECT {_NANOS}, 'kv', {_KV} FROM events""",
    "k2_double_to_g": f"""SELECT l_orderkey, l_linenumber, l_partkey,
        {g_text('l_extendedprice')} AS plain, {g_text('(l_extendedprice * 1000.0::DOUBLE)')} AS large,
        {g_text('(l_extendedprice / -3e9::DOUBLE)')} AS small FROM lineitem""",
    "k3_complex_value_to_string": f"""SELECT {_NANOS}, 'list' AS key, {_LIST} AS text FROM events
        UNION ALL SELECT {_NANOS}, 'kv', {_KV} FROM events
        UNION ALL SELECT {_NANOS}, 'raw', base64(encode(event_type)) FROM events""",
    "k4_kv_to_map": f"""SELECT {_NANOS}, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR)
        ELSE 'first' END AS dup, 9 AS keys FROM events""",
    "k5_strip_empty_keys": f"""SELECT {_NANOS}, 11 AS "before",
        CASE WHEN event_id % 3 = 0 THEN 10 ELSE 9 END AS "after" FROM events""",
    "k6_service_name": """SELECT CASE WHEN user_id % 5 = 0 THEN '' ELSE 's' || user_id END
        AS "ServiceName", 'second' AS mapped, count(*) AS metrics FROM events GROUP BY 1""",
    "k7_nanos_to_time": """WITH t AS (SELECT event_id,
          epoch_us(ts) * 1000 - 1705000000000000000 + event_id AS n FROM events), f AS (
          SELECT *, (n - ((n % 1000) + 1000) % 1000) // 1000 AS micros FROM t)
        SELECT event_id, n, micros, CAST(CAST(make_timestamp(micros) AS DATE) AS VARCHAR) AS day FROM f""",
    "k8_number_value": f"""SELECT {_NANOS}, CASE event_id % 3 WHEN 0 THEN value
        WHEN 1 THEN CAST(event_id AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value FROM events""",
    "k9_is_finite": "SELECT event_id, true AS plain, event_id % 4 = 3 AS odd FROM events",
    "k10_map_keys_values": f"""WITH {EV}, {LI}, kv AS (
          SELECT DISTINCT metric AS m, key, 'k' AS a, k AS v FROM ev
          UNION SELECT 'lineitem.quantity', key, 'linestatus', ls FROM li
          UNION SELECT 'lineitem.quantity', key, 'returnflag', rf FROM li
          UNION SELECT 'lineitem.quantity.exp', l_returnflag, 'returnflag', l_returnflag FROM lineitem
          UNION SELECT 'orders.price', o_orderpriority, 'priority', o_orderpriority FROM orders
          UNION SELECT 'orders.price.summary', o_orderpriority, 'priority', o_orderpriority FROM orders)
        SELECT m AS "MetricName", 'key' AS part, a AS text, count(*) AS series FROM kv GROUP BY m, a
        UNION ALL SELECT m, 'value', v, count(*) FROM kv GROUP BY m, v""",
    "k11_unix_nanos": f"""WITH {LI} SELECT {_DAY}, min(nanos) AS first, max(nanos) AS last
        FROM li GROUP BY 1""",
    "k12_or_default": f"""WITH {EX} SELECT nanos, n AS count, true AS unset, CAST(0 AS DOUBLE) AS min,
        -1 AS negative_offset FROM ex""",
}
