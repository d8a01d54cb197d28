"""Requests to the stored tables, all tables of a batch at once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.operators.flatten import flatten_metrics, nameless_metrics
from metricloom.operators.mapping import (
    map_points,
    map_series,
    point_heads,
    rejects_of_requests,
    series_of_requests,
    slim,
)
from metricloom.operators.validate import nameless_rejects, validate
from metricloom.schema import POINT_TABLES
from metricloom.session import input_splits
from metricloom.sources import files
from metricloom.sources.manifest import add_batch, commit, is_done, load, new_write_id
from metricloom.sources.requests import read_heads, read_requests, requests_with, unreadable_rejects
from metricloom.sources.tables import (
    append_ledger,
    create_tables,
    put_bounded_points,
    put_new_series,
    put_points,
    put_rejects,
    scan_series,
)

# Table, rows, duration in ms, error text.
Entry = tuple[str, int, int, str | None]
# Rows by table, of each write of a batch.
Writes = dict[int, dict[str, int]]
# Gives the flattened metrics with (at least) the payloads of the named tables.
FlatSource = Callable[[tuple[str, ...]], DataFrame]
# Gives the requests with what series (or, if false, rejects alone) need of the payloads of the named tables.
HeadSource = Callable[[tuple[str, ...], bool], DataFrame]

# Writer of batches of files, unless the caller names another.
FILES = "files"


def _attempt(
    writes: Writes, tables: Iterable[str], write_id: int, write: Callable[[int], Writes]
) -> list[Entry]:
    """Run one job and describe the writes it made; a failure is one of each of its tables."""
    started = time.monotonic()

    def spent() -> int:
        return int((time.monotonic() - started) * 1000)

    try:
        made = write(write_id)
    except Exception as failure:  # noqa: BLE001 - recorded here, raised by write_batch
        return [(table, 0, spent(), f"{type(failure).__name__}: {failure}") for table in tables]
    writes.update(made)
    # Writes of one job took a share of its time each.
    share = spent() // max(1, len(made))
    return [(table, rows, share, None) for found in made.values() for table, rows in found.items()]


def write_batch(
    spark: SparkSession,
    source: FlatSource,
    base: str,
    batch_id: int,
    ingest_time: datetime,
    tables: Iterable[str] = tuple(POINT_TABLES),
    requests: DataFrame | None = None,
    writer: str = FILES,
    owner: str | None = None,
    max_points: int | None = None,
    heads: HeadSource | None = None,
) -> list[Entry]:
    """Store one batch of flattened metrics, whole or not at all, and once.

    The points of all types are one job, the series and the rejects, of ``requests`` that could not be
    read too, are another each; they run side by side. One commit then makes all of them
    visible, so no stored point is without its catalogue row. A batch is known by its ``writer`` and
    id: one that is stored already is left as it is, whoever asks. ``owner`` is the
    application that holds the writer's name; if another one took it over, the batch is refused.
    ``max_points`` bounds the points of a write: the job then makes as many writes as it takes, each with
    folders of its own; one commit names all of them. With ``heads`` the series and rejects come from the requests
    that it gives, with less work, and not from ``source``.

    Every write counts its rows as it runs; what has no rows leaves no folder and no ledger
    entry. If one fails, its error is recorded and the batch ends with it, to be run again;
    what the others wrote is removed.
    """
    if is_done(load(spark, base), writer, batch_id):
        return []
    tables = tuple(tables)
    flat = source(tables) if heads is None else None
    writes: Writes = {}
    steps: list[tuple] = []  # run side by side

    def step(names: tuple[str, ...], write: Callable[[int], Writes]) -> tuple:
        write_id = new_write_id()
        writes[write_id] = {}
        return names, write_id, write

    def points(write_id: int) -> Writes:
        own = {t: slim(map_points(flat if flat and len(tables) == 1 else source((t,)), t), t) for t in tables}
        if max_points:
            return put_bounded_points(own, base, write_id, max_points)
        return {write_id: put_points(own, base, write_id)}

    def series(write_id: int) -> Writes:
        known = scan_series(spark, base, ["SeriesID"])
        if heads is None:
            rows = map_series(flat, ingest_time)
        else:
            rows = series_of_requests({t: heads((t,), True) for t in tables}, ingest_time)
        return {write_id: put_new_series(rows, known, base, write_id)}

    def rejects() -> DataFrame:
        if heads is None:
            rows = nameless_rejects(nameless_metrics(source(()) if len(tables) != 1 else flat))
            if tables:
                rows = validate(point_heads(flat))[1].unionByName(rows)
        else:
            rows = rejects_of_requests({t: heads((t,), False) for t in tables}, heads((), False))
        return rows if requests is None else rows.unionByName(unreadable_rejects(requests))

    if tables:
        steps.append(step(tables, points))
        steps.append(step(("series",), series))
    steps.append(step(("rejects",), lambda n: {n: put_rejects(rejects(), base, n, writer, batch_id)}))
    with ThreadPoolExecutor(len(steps)) as pool:
        entries = [entry for own in pool.map(lambda one: _attempt(writes, *one), steps) for entry in own]
    try:
        failed = next((e for e in entries if e[3] is not None), None)
        if failed is not None:
            raise RuntimeError(f"batch {batch_id}: write of {failed[0]} failed: {failed[3]}")
        commit(spark, base, lambda s: add_batch(s, writes, writer, batch_id, owner))
    except Exception as failure:
        # What was written is in no commit, and goes.
        entries = [(t, 0, ms, error or f"not stored: {failure}") for t, _, ms, error in entries]
        for write_id in writes:
            for table in ("points", "series", "rejects"):
                files.delete(spark, f"{base}/{table}/write={write_id}")
        raise
    finally:
        if entries:
            append_ledger(spark, entries, base, writer, batch_id)
    return entries


def units_of(flat: DataFrame, most: int) -> list[DataFrame]:
    """Flattened metrics in parts of at most ``most`` points, in their order.

    ``flat`` is cached. A metric with more than half of that is cut into pieces of its points. Pieces are counted
    by partition, then in order within it, on their numbers alone; every part is a range of
    those numbers, so that the wide rows are neither shuffled nor sorted. What reaches the
    driver is one number per part.
    """
    half = max(1, most // 2)
    arms = [arm for _, arm, _ in POINT_TABLES.values() if arm in flat.columns]
    # A metric without a name is one reject, however many points it has.
    size = F.when(F.col("MetricName") == "", 0).otherwise(
        F.coalesce(*[F.size(F.col(f"{arm}.dataPoints")) for arm in arms], F.lit(0))
    )
    last = F.greatest(F.ceil(size / half) - 1, F.lit(0)).cast("int")
    pieces = flat.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
    # Where a metric is one piece, its points stay as they are.
    whole = last == 0
    cut = {
        arm: F.when(F.col(arm).isNull() | whole, F.col(arm)).otherwise(
            F.col(arm).withField("dataPoints", F.slice(f"{arm}.dataPoints", F.col("_piece") * half + 1, half))
        )
        for arm in arms
    }
    numbered = pieces.withColumns(cut).drop("_piece").withColumn("_number", F.monotonically_increasing_id())
    count = F.when(F.col("MetricName") == "", 0).otherwise(
        F.coalesce(*[F.size(F.col(f"{arm}.dataPoints")) for arm in arms], F.lit(0))
    )
    sizes = numbered.select("_number", F.shiftright("_number", 33).alias("part"), count.alias("n"))
    totals = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select(
        F.col("part").alias("_part"),
        (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"),
    )
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("_number")) - F.col("n")
    placed = sizes.withColumn("inside", inside).join(F.broadcast(before), F.col("part") == F.col("_part"))
    unit = F.expr(f"(before + inside) DIV {half}")
    starts = placed.groupBy(unit.alias("unit")).agg(F.min("_number").alias("first")).orderBy("unit").collect()
    if len(starts) < 2:
        return [flat]
    bounds = [r["first"] for r in starts[1:]]
    lows, highs = [None, *bounds], [*bounds, None]
    out = []
    for low, high in zip(lows, highs, strict=True):
        own = numbered
        if low is not None:
            own = own.filter(F.col("_number") >= low)
        if high is not None:
            own = own.filter(F.col("_number") < high)
        out.append(own.drop("_number"))
    return out


def present_tables(metrics: DataFrame) -> list[str]:
    """H9: tables for which a batch holds at least one metric."""
    counts = metrics.agg(
        *[F.count_if(F.col(arm).isNotNull()).alias(t) for t, (_, arm, _) in POINT_TABLES.items()]
    ).first()
    return [table for table in POINT_TABLES if counts[table]]


def table_files(metrics: DataFrame) -> dict[str, list[str]]:
    """H9: files that hold at least one metric of a table, for the tables that have one. ``metrics`` has their ``file``."""
    held = metrics.groupBy("file").agg(
        *[F.max(F.col(arm).isNotNull()).alias(t) for t, (_, arm, _) in POINT_TABLES.items()]
    )
    found: dict[str, list[str]] = {}
    for row in held.collect():
        for table in POINT_TABLES:
            if row[table]:
                found.setdefault(table, []).append(unquote(row["file"]))
    return {table: sorted(found[table]) for table in POINT_TABLES if table in found}


def ingest_files(
    spark: SparkSession,
    path: str | list[str],
    base: str,
    batch_id: int,
    ingest_time: datetime,
    format: str = "parquet",
    writer: str = FILES,
    owner: str | None = None,
    max_points: int | None = None,
) -> list[Entry]:
    """Store a large batch of request files; ``owner`` and ``max_points`` are as in ``write_batch``.

    Nothing is cached: a narrow pass finds which files hold which types; the branch of a
    type reads its own files with a schema narrowed
    to its own payload, and series and rejects to what they need of it. JSON
    has to be landed first (``land_requests``), since every pass would parse all of it.
    """
    if format == "json":
        raise ValueError("land JSON requests as Parquet first, with land_requests")
    create_tables(spark, base)
    if is_done(load(spark, base), writer, batch_id):
        return []
    with input_splits(spark):
        bare = read_requests(spark, path, format, presence=True)
        scopes = bare.select(
            F.col("_metadata.file_path").alias("file"), F.explode("resourceMetrics").alias("r")
        ).selectExpr("file", "explode(r.scopeMetrics) as s")
        held = table_files(scopes.selectExpr("file", "explode(s.metrics) as m").select("file", "m.*"))

        def paths(tables: tuple[str, ...]) -> str | list[str]:
            own = sorted({f for t in tables for f in held[t]})
            # A name that reads as a pattern can't be asked for.
            return own if own and not any(c in f for f in own for c in "{}[]*?\\") else path

        def source(tables: tuple[str, ...]) -> DataFrame:
            requests = read_requests(spark, paths(tables), format, tables)
            return flatten_metrics(requests_with(requests, tables) if len(tables) == 1 else requests)

        def heads(tables: tuple[str, ...], attributes: bool) -> DataFrame:
            return read_heads(spark, paths(tables), tables, attributes, format)

        requests = read_requests(spark, path, format, ())
        return write_batch(
            spark, source, base, batch_id, ingest_time, tuple(held), requests, writer, owner, max_points, heads
        )
