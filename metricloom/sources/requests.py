"""A1, A2: export requests from files (or Kafka, where its package is present)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.schema import POINT_TABLES, UNREADABLE_REQUEST, head_schema, request_schema

# Keeps the text of a request that is no valid JSON instead of dropping it.
_KEEP_UNREADABLE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}
# Files of one micro-batch, unless the caller says otherwise.
MAX_FILES = 64
# Row groups of landed requests, before compression.
ROW_GROUP_BYTES = 8 * 2**20


def read_requests(
    spark: SparkSession,
    path: str | list[str],
    format: str = "json",
    tables: Iterable[str] = tuple(POINT_TABLES),
    presence: bool = False,
) -> DataFrame:
    """A1: one row per export request, OTLP/JSON lines or the same tree in Parquet.

    ``tables`` narrows the read schema to the payloads that are needed; with
    Parquet the others are not read from storage. With ``presence`` payloads come without
    their contents, to see which are there.
    """
    reader = spark.read.schema(request_schema(tables, presence)).format(format)
    return reader.options(**_KEEP_UNREADABLE).load(path)


def read_heads(
    spark: SparkSession, path: str | list[str], tables: Iterable[str], attributes: bool = True, format: str = "parquet"
) -> DataFrame:
    """A1: export requests with what their series and rejects (without ``attributes``, rejects alone) need."""
    return spark.read.schema(head_schema(tables, attributes)).format(format).options(**_KEEP_UNREADABLE).load(path)


def requests_with(requests: DataFrame, tables: Iterable[str]) -> DataFrame:
    """Requests in which a metric has a payload of one of ``tables``; the others have no points for them."""
    held = " or ".join(f"m.{POINT_TABLES[t][1]} is not null" for t in tables)
    return requests.filter(
        f"exists(resourceMetrics, r -> exists(r.scopeMetrics, s -> exists(s.metrics, m -> {held})))"
    )


def unreadable_rejects(requests: DataFrame) -> DataFrame:
    """C4: one reject per request that could not be parsed."""
    unread = F.col("unreadable").isNotNull() & F.col("resourceMetrics").isNull()
    return requests.filter(unread).select(
        F.lit(UNREADABLE_REQUEST).alias("reason"),
        F.lit(None).cast("string").alias("MetricName"),
        F.lit(None).cast("string").alias("MetricType"),
    )


def stream_requests(
    spark: SparkSession,
    path: str,
    format: str = "json",
    max_files: int = MAX_FILES,
    max_bytes: int | None = None,
) -> DataFrame:
    """A2: requests as a stream of files. J3: the caps bound one micro-batch.

    A micro-batch is held in memory and disk of the executors while it is stored, unless it is Parquet files
    as they are, so there is always a cap: ``max_bytes`` if given, else ``max_files``.
    """
    reader = spark.readStream.schema(request_schema()).format(format).options(**_KEEP_UNREADABLE)
    if max_bytes is not None:
        return reader.option("maxBytesPerTrigger", max_bytes).load(path)
    return reader.option("maxFilesPerTrigger", max_files).load(path)


def stream_kafka_requests(spark: SparkSession, **options: str) -> DataFrame:
    """A2: requests as OTLP/JSON Kafka messages; needs Spark's Kafka package."""
    messages = spark.readStream.format("kafka").options(**options).load()
    parsed = F.from_json(F.col("value").cast("string"), request_schema(), _KEEP_UNREADABLE)
    return messages.select(parsed.alias("request")).select("request.*")


def land_requests(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write requests as Parquet, so later passes read only the payloads they need.

    Requests may lack payload columns that none of them has; with the mode ``append`` those of several kinds
    share a folder. Row groups are small, since the work on a request is many times that of reading it: a pass
    can be divided within files too.
    """
    options = {"compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES}
    requests.write.mode(mode).options(**options).parquet(path)
