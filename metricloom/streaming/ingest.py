"""Continuous ingest into the six tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from metricloom.operators.flatten import flatten_metrics
from metricloom.plans.ingest import ingest_files, present_tables, write_batch
from metricloom.schema import request_schema
from metricloom.session import input_splits
from metricloom.sources import files
from metricloom.sources.manifest import commit, hold, is_done, let_go, load
from metricloom.sources.tables import create_tables

# Writer of micro-batches that belong to no stream of this module.
MICRO_BATCHES = "micro-batches"
# Options of a file stream that say which files a micro-batch has, and nothing of how they are read.
_CAPS = {"path", "mode", "columnnameofcorruptrecord", "maxfilespertrigger", "maxbytespertrigger"}


def ingest_micro_batch(
    requests: DataFrame,
    base: str,
    batch_id: int,
    ingest_time: datetime | None = None,
    writer: str = MICRO_BATCHES,
    owner: str | None = None,
    max_points: int | None = None,
) -> None:
    """Store one micro-batch: parse and flatten once, then write the tables it holds.

    The micro-batch is bounded by the caps of the source. Its flattened metrics
    are cached for the writes; a lost executor only costs recomputing its part.
    ``max_points`` bounds the points of each write (J3); one commit names all writes of the batch.
    A replay of one that is stored changes nothing. An empty micro-batch stores and records nothing.
    """
    spark = requests.sparkSession
    if is_done(load(spark, base), writer, batch_id) or requests.isEmpty():
        return
    moment = ingest_time or datetime.now(timezone.utc)
    flat = flatten_metrics(requests).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tables = present_tables(flat)
        write_batch(
            spark, lambda _: flat, base, batch_id, moment, tables, requests, writer, owner, max_points
        )
    finally:
        flat.unpersist()


def names_files(stream: DataFrame) -> bool:
    """Whether a stream is Parquet files of requests, just as they are: its micro-batches are known by their files."""
    plan = stream._jdf.queryExecution().analyzed()
    if plan.nodeName() != "StreamingRelation" or plan.dataSource().className() != "parquet":
        return False
    options = plan.dataSource().options().keySet().mkString("\n").lower().split("\n")
    return set(options) <= _CAPS and stream.schema.simpleString() == StructType.fromDDL(request_schema()).simpleString()


def ingest_named_files(
    names: DataFrame,
    base: str,
    batch_id: int,
    writer: str = MICRO_BATCHES,
    owner: str | None = None,
    max_points: int | None = None,
) -> None:
    """Store one micro-batch of Parquet files, given as a column of their paths with one row a request.

    As ``ingest_micro_batch``, but nothing of it is held in memory or on disk meanwhile: each pass reads what it
    needs of the files, as that of a batch of files does.
    """
    spark = names.sparkSession
    if is_done(load(spark, base), writer, batch_id):
        return
    # Paths are read as patterns.
    paths = sorted(re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(path)) for (path,) in names.distinct().collect())
    if paths:
        moment = datetime.now(timezone.utc)
        ingest_files(spark, paths, base, batch_id, moment, writer=writer, owner=owner, max_points=max_points)


def stream_identity(spark: SparkSession, checkpoint: str) -> str:
    """The name that the stream of a checkpoint writes under, kept in the checkpoint.

    A stream with a new checkpoint counts its batches from zero again; its name keeps them apart.
    """
    path = f"{checkpoint}/metricloom-writer"
    known = files.read_text(spark, path)
    if known is None:
        files.make_folder(spark, checkpoint)
        draft = f"{path}.{uuid.uuid4().hex}"
        files.write_text(spark, draft, f"stream-{uuid.uuid4().hex}")
        files.publish(spark, draft, path)  # whoever is first gives the name
        known = files.read_text(spark, path)
    return known.strip()


def _started(
    stream: DataFrame, base: str, checkpoint: str, take_over: bool, max_points: int | None, **trigger
) -> StreamingQuery:
    spark = stream.sparkSession
    create_tables(spark, base)
    writer, owner = stream_identity(spark, checkpoint), spark.sparkContext.applicationId
    commit(spark, base, lambda s: hold(s, writer, owner, take_over=take_over))
    step: Callable[..., None] = ingest_micro_batch
    if names_files(stream):
        step, stream = ingest_named_files, stream.select("_metadata.file_path")
    # A stream takes its settings when it starts.
    with input_splits(spark):
        return (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(
                lambda batch, n: step(batch, base, n, writer=writer, owner=owner, max_points=max_points)
            )
            .trigger(**trigger)
            .start()
        )


def start_ingest(
    stream: DataFrame,
    base: str,
    checkpoint: str,
    interval: str = "1 second",
    take_over: bool = False,
    max_points: int | None = None,
) -> StreamingQuery:
    """Continuous ingest, one micro-batch per interval.

    Any number of streams share a base, each with its own checkpoint. While one application
    runs the stream of a checkpoint, another one that starts it is refused, for ten
    minutes after the last batch; ``take_over`` takes it from one that died. Writes hold
    ``max_points`` points at the most, if given.
    """
    return _started(stream, base, checkpoint, take_over, max_points, processingTime=interval)


def drain(
    stream: DataFrame,
    base: str,
    checkpoint: str,
    take_over: bool = False,
    max_points: int | None = None,
) -> StreamingQuery:
    """Ingest everything that is there, then stop and let the stream's name go."""
    spark = stream.sparkSession
    query = _started(stream, base, checkpoint, take_over, max_points, availableNow=True)
    try:
        query.awaitTermination()
    finally:
        writer, owner = stream_identity(spark, checkpoint), spark.sparkContext.applicationId
        commit(spark, base, lambda s: let_go(s, writer, owner))
    return query
