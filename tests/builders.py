"""Python dicts in the shape of OTLP/JSON."""

T0 = 1_700_000_000_000_000_000


def kv(key, value):
    if isinstance(value, bool):
        return {"key": key, "value": {"boolValue": value}}
    if isinstance(value, int):
        return {"key": key, "value": {"intValue": str(value)}}
    if isinstance(value, float):
        return {"key": key, "value": {"doubleValue": value}}
    if isinstance(value, dict):
        return {"key": key, "value": value}
    return {"key": key, "value": {"stringValue": value}}


def attrs(mapping):
    return [kv(k, v) for k, v in (mapping.items() if isinstance(mapping, dict) else mapping)]


def request(*metrics, resource=(("service.name", "svc-a"), ("host.name", "h1")), scope="scope-a",
            version="1.0.0", schema_url="https://example.org/schemas/1"):
    return {
        "resourceMetrics": [
            {
                "resource": {"attributes": attrs(resource)},
                "schemaUrl": schema_url,
                "scopeMetrics": [
                    {"scope": {"name": scope, "version": version}, "metrics": list(metrics)}
                ],
            }
        ]
    }


def number(value=None, time=T0, attributes=(), **more):
    point = {"attributes": attrs(attributes), "timeUnixNano": str(time), **more}
    if isinstance(value, int):
        point["asInt"] = str(value)
    elif value is not None:
        point["asDouble"] = value
    return point


def gauge(name, *points, **more):
    return {"name": name, "gauge": {"dataPoints": list(points)}, **more}


def total(name, *points, temporality=2, monotonic=True):
    return {
        "name": name,
        "sum": {
            "dataPoints": list(points),
            "aggregationTemporality": temporality,
            "isMonotonic": monotonic,
        },
    }
