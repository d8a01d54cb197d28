"""E2s: new-series filter of a stream, bounded by ingest time."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.sources.manifest import add_batch, commit, hold, is_done, let_go, load, new_write_id
from metricloom.sources.tables import create_tables, put_new_series, recent_series
from metricloom.streaming.ingest import stream_identity


def new_series_stream(series: DataFrame, horizon: str) -> DataFrame:
    """E2s: each SeriesID once per ``horizon`` (such as "1 hour") of ingest time, as a stream.

    State holds only the IDs of the horizon. The watermark runs on the time
    the row is read, never on the time of a point: points may be of any age
    and must not be dropped as late. An ID that comes again after the horizon
    is emitted again, which the catalogue collapses. Every row is shuffled to the state
    of its ID; where a series may own a large part of them, use ``store_new_series``.
    """
    return (
        series.withColumn("_ingested", F.current_timestamp())
        .withWatermark("_ingested", horizon)
        .dropDuplicatesWithinWatermark(["SeriesID"])
        .drop("_ingested")
    )


def store_new_batch(
    series: DataFrame,
    base: str,
    batch_id: int,
    horizon: timedelta,
    writer: str,
    owner: str | None = None,
    now: datetime | None = None,
) -> None:
    """E2s: store the rows of a batch whose series were not stored within the last ``horizon``.

    Equal rows of the batch combine before they are shuffled; a series that owns most of them costs one
    row per task. What is new is then asked of the SeriesIDs alone, and the wide rows of the new ones
    are found by a join with those few IDs. What was stored within the horizon is the state: of its
    files the IDs are read and nothing else. A batch that is stored already is left as it is.
    """
    spark = series.sparkSession
    if is_done(load(spark, base), writer, batch_id):
        return
    since = (now or datetime.now(timezone.utc)) - horizon
    write_id = new_write_id()
    found = put_new_series(series, recent_series(spark, base, since), base, write_id)
    commit(spark, base, lambda s: add_batch(s, {write_id: found}, writer, batch_id, owner))


def store_new_series(
    stream: DataFrame, base: str, checkpoint: str, horizon: timedelta, take_over: bool = False
) -> StreamingQuery:
    """E2s: store the new series of all there is of a stream, micro-batch by micro-batch, then stop."""
    spark: SparkSession = stream.sparkSession
    create_tables(spark, base)
    writer, owner = stream_identity(spark, checkpoint), spark.sparkContext.applicationId
    commit(spark, base, lambda s: hold(s, writer, owner, take_over=take_over))
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, n: store_new_batch(batch, base, n, horizon, writer, owner))
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        commit(spark, base, lambda s: let_go(s, writer, owner))
    return query
