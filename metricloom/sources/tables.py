"""The stored tables.

Layout under one base path, all Parquet but for the small files of the driver::

    series/write=W/                        catalogue rows of one write
    points/write=W/table=T/TimeDate=D/     points of one write, by type and UTC day
    rejects/write=W/
    attribute_index/write=W/scope=S/       index of some writes of the catalogue
    ledger/*.json                          what was attempted
    manifest/N.json                        which of the folders are live

Every write makes folders under a number of its own; they are live once a
commit of the manifest names them, and until a later commit says what took them over. Readers ask
the manifest and nothing else, so neither batch numbers nor the order of writers matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from metricloom.operators.catalogue import (
    INDEXED,
    attribute_index,
    compact_series,
    distinct_rows,
    new_series,
)
from metricloom.schema import ATTRIBUTE_INDEX, LEDGER, POINTS, REJECTS, SERIES
from metricloom.sources import files, manifest
from metricloom.sources.manifest import began, commit, live, load, new_write_id

# False-positive rate of the scalar bloom filters.
BLOOM_FPP = "0.01"
SERIES_BLOOM_COLUMNS = ("ServiceName", "MetricName")
# Leading bits of the SeriesID that spread the catalogue over several writers. The
# ID is a uniform hash, so equal bits are equal, disjoint ranges of it.
SERIES_RANGE_BITS = 4
# Writer of batches that a program stores table by table.
DIRECT = "direct"

_PARQUET = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def _bloom(*columns: str) -> dict[str, str]:
    """Writer options for bloom filters on some columns."""
    # Adaptive filters are sized by the distinct values seen, not one megabyte each.
    options = {"parquet.bloom.filter.adaptive.enabled": "true"}
    for column in columns:
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.fpp#{column}"] = BLOOM_FPP
    return options


# ---------------------------------------------------------------- writers


def put_rows(rows: DataFrame, path: str, counts: dict, by: Iterable[str] = (), **options: str) -> dict[str, int]:
    """Write a folder and give ``counts`` of its rows, without those that are zero.

    Rows are counted in the last stage, where a rerun of a lost task counts once.
    What turns out empty leaves no folder (H9).
    """
    seen = Observation()
    counted = rows.observe(seen, *[column.alias(name) for name, column in counts.items()])
    counted.write.options(**_PARQUET, **options).partitionBy(*by).parquet(path)
    found = {name: n for name, n in seen.get.items() if n}
    if not found:
        files.delete(rows.sparkSession, path)
    return found


def put_series(series: DataFrame, base: str, write_id: int) -> dict[str, int]:
    """H1: catalogue rows, sorted by SeriesID within files. Returns {"series": rows}."""
    ranged = series.withColumn("_range", F.shiftright("SeriesID", 64 - SERIES_RANGE_BITS))
    return put_rows(
        ranged.hint("rebalance", "_range").drop("_range").sortWithinPartitions("SeriesID"),
        f"{base}/series/write={write_id}",
        {"series": F.count(F.lit(1))},
        **_bloom(*SERIES_BLOOM_COLUMNS),
    )


def put_new_series(series: DataFrame, known: DataFrame, base: str, write_id: int) -> dict[str, int]:
    """Store the rows of a batch whose series are not in ``known``. Returns {"series": rows}.

    Points of a series repeat its row; each different row is kept once, and only those are
    cached, compared and sorted. The batch itself is read once.
    """
    rows = distinct_rows(series).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return put_series(new_series(rows, known), base, write_id)
    finally:
        rows.unpersist()


def put_points(
    points: dict[str, DataFrame], base: str, write_id: int, by_range: bool = False
) -> dict[str, int]:
    """H2-H7: slim points of several types in one job. Returns the rows of each table.

    The types become one union with a column for each of theirs; a type's files
    hold nothing in the others' columns, and readers do not read them.
    Rows are shuffled by (type, day) and sorted by (SeriesID, time). The
    shuffle is a rebalance: adaptive execution joins small groups into one task
    and splits large ones, so neither a busy day nor a single hot series ends up in one task,
    and a day that is not busy is one file, however many days and tasks there are.
    ``by_range`` makes it a range shuffle, which reads ``points`` twice: tasks then hold consecutive
    days and SeriesIDs, so that the files of a busy day each hold a narrow range of series.
    """
    labelled = [rows.withColumn("table", F.lit(table)) for table, rows in points.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
    order = ("table", "TimeDate", "SeriesID", "TimeUnixNano")
    dealt = united.repartitionByRange(*order) if by_range else united.hint("rebalance", "table", "TimeDate")
    sorted_rows = dealt.sortWithinPartitions(*order)
    counts = {table: F.count_if(F.col("table") == table) for table in points}
    # Files that stay are worth a filter that tells which of their row groups hold a series.
    bloom = _bloom("SeriesID") if by_range else {}
    return put_rows(
        sorted_rows, f"{base}/points/write={write_id}", counts, ("table", "TimeDate"), **bloom
    )


def put_bounded_points(
    points: dict[str, DataFrame], base: str, write_id: int, most: int
) -> dict[int, dict[str, int]]:
    """As ``put_points``, in writes of at most ``most`` points each. Returns the rows of each table by write.

    All of them are one job, however many there are. The sorted rows of a task are cut after every ``most``
    of them, so a write holds few days and is few files. The job makes one folder with a folder of
    each write in it, which then gets its place and a number of its own; the driver sees one row for
    each write and table.
    """
    labelled = [rows.withColumn("table", F.lit(table)) for table, rows in points.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
    order = ("table", "TimeDate", "SeriesID", "TimeUnixNano")
    dealt = united.hint("rebalance", "table", "TimeDate").sortWithinPartitions(*order)
    # The number of a row: its task, then 33 bits of its place in there.
    numbered = dealt.withColumn("_number", F.monotonically_increasing_id())
    unit = F.expr(f"shiftright(_number, 33) * {2**33 // most + 1} + (_number & {2**33 - 1}) div {most}")
    units = numbered.withColumn("unit", unit).drop("_number").sortWithinPartitions("unit", *order)
    spark, folder = united.sparkSession, f"{base}/points/write={write_id}"
    units.write.options(**_PARQUET).partitionBy("unit", "table", "TimeDate").parquet(folder)
    schema = "SeriesID BIGINT, unit BIGINT, table STRING, TimeDate DATE"
    found = spark.read.schema(schema).parquet(folder).groupBy("unit", "table").count().collect()
    ids: dict[int, int] = {}
    writes: dict[int, dict[str, int]] = {}
    for row in sorted(found):
        if row["unit"] not in ids:
            ids[row["unit"]] = max(new_write_id(), max(writes, default=0) + 1)
        writes.setdefault(ids[row["unit"]], {})[row["table"]] = row["count"]
    try:
        files.move(spark, {f"{folder}/unit={u}": f"{base}/points/write={n}" for u, n in ids.items()})
    except Exception:
        for n in writes:
            files.delete(spark, f"{base}/points/write={n}")
        raise
    files.delete(spark, folder)
    return writes


def put_rejects(rejects: DataFrame, base: str, write_id: int, writer: str, batch_id: int) -> dict[str, int]:
    """C4: rejects of one batch. Returns {"rejects": rows}."""
    marked = rejects.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("bigint")})
    return put_rows(
        marked.hint("rebalance"), f"{base}/rejects/write={write_id}", {"rejects": F.count(F.lit(1))}
    )


def _published(spark: SparkSession, base: str, table: str, write_id: int, found: dict, batch_id: int) -> None:
    commit(spark, base, lambda s: manifest.put_table(s, write_id, table, found.get(table, 0), DIRECT, batch_id))


def write_series(series: DataFrame, base: str, batch_id: int) -> None:
    """H1: the catalogue rows of a batch on their own, in place of what the batch had."""
    write_id = new_write_id()
    found = put_series(series, base, write_id)
    _published(series.sparkSession, base, "series", write_id, found, batch_id)


def write_points(points: DataFrame, table: str, base: str, batch_id: int) -> None:
    """H2-H7: the points of a type of a batch on their own, in place of what the batch had."""
    write_id = new_write_id()
    found = put_points({table: points}, base, write_id)
    _published(points.sparkSession, base, table, write_id, found, batch_id)


def write_rejects(rejects: DataFrame, base: str, batch_id: int) -> None:
    """C4: the rejects of a batch on their own, in place of what the batch had."""
    write_id = new_write_id()
    found = put_rejects(rejects, base, write_id, DIRECT, batch_id)
    _published(rejects.sparkSession, base, "rejects", write_id, found, batch_id)


def append_ledger(
    spark: SparkSession, entries: list[tuple], base: str, writer: str, batch_id: int
) -> None:
    """One row per attempted write. Attempts add up; nothing is replaced."""
    names = ("table", "rows", "duration_ms", "error")
    rows = [dict(zip(names, e, strict=True), writer=writer, batch_id=batch_id) for e in entries]
    files.write_text(
        spark, f"{base}/ledger/{new_write_id()}.json", "".join(json.dumps(r) + "\n" for r in rows)
    )


def create_tables(spark: SparkSession, base: str) -> None:
    """H8: make the tables, series first; tables that exist keep their rows."""
    for table in ("series", "points", "rejects", "ledger", "attribute_index", "manifest"):
        files.make_folder(spark, f"{base}/{table}")


# ---------------------------------------------------------------- readers


def read_writes(spark: SparkSession, root: str, ids: list[int], schema: str, inner: str = "") -> DataFrame:
    """The folders of some writes, with their number as column ``write``; no others are listed."""
    schema = f"{schema}, write BIGINT"
    if not ids:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/write={n}{inner}" for n in ids]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)


def _ids(state: dict, table: str) -> list[int]:
    return [w["id"] for w in live(state, table)]


def read_points(spark: SparkSession, base: str, table: str, ids: list[int]) -> DataFrame:
    schema = f"{POINTS[table]}, TimeDate DATE"
    return read_writes(spark, f"{base}/points", ids, schema, f"/table={table}").drop("write", "table")


def scan_points(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Points of one type, of all writes that are live."""
    return read_points(spark, base, table, _ids(load(spark, base), table))


def scan_rows(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Rows of the rejects or ledger table, with their writer and batch id."""
    owner = "writer STRING, batch_id BIGINT"
    if table == "ledger":
        return spark.read.schema(f"{LEDGER}, {owner}").json(f"{base}/ledger")
    ids = _ids(load(spark, base), table)
    return read_writes(spark, f"{base}/{table}", ids, f"{REJECTS}, {owner}").drop("write")


def scan_series(
    spark: SparkSession, base: str, cols: Iterable[str] | None = None
) -> DataFrame:
    """A3: catalogue rows as written, with ``write``: of the merged catalogue and of later writes.

    A series may have several versions; read it through ``compact_series``.
    """
    rows = read_writes(spark, f"{base}/series", _ids(load(spark, base), "series"), SERIES)
    return rows.select(*cols) if cols is not None else rows


def recent_series(spark: SparkSession, base: str, since: datetime) -> DataFrame:
    """SeriesIDs of the catalogue's writes that began after a moment."""
    ids = [n for n in _ids(load(spark, base), "series") if began(n) > since]
    return read_writes(spark, f"{base}/series", ids, SERIES).select("SeriesID")


def _index_rows(spark: SparkSession, base: str, ids: list[int]) -> DataFrame:
    return read_writes(spark, f"{base}/attribute_index", ids, f"{ATTRIBUTE_INDEX}, scope STRING")


def _not_indexed(state: dict) -> list[int]:
    """Writes of the catalogue that no live part of the index covers."""
    covered = {n for w in live(state, "attribute_index") for n in w["covers"]}
    return [n for n in _ids(state, "series") if n not in covered]


def _current(rows: DataFrame, later: DataFrame) -> DataFrame:
    """Index rows whose series does not come again in a later part; ``later`` is (SeriesID, write)."""
    newer = later.select(F.col("SeriesID").alias("_id"), F.col("write").alias("_write"))
    kept = rows.join(newer, (F.col("SeriesID") == F.col("_id")) & (F.col("write") < F.col("_write")), "left_anti")
    return kept.select("scope", "key", "value", "SeriesID")


def scan_attribute_index(spark: SparkSession, base: str) -> DataFrame:
    """The attribute index, never behind the catalogue: (scope, key, value, SeriesID).

    The index is a base and deltas of later writes. Series that no part covers yet come from the
    catalogue itself. A series that a later part or write holds again is told by that one alone; the
    series of a delta are rows of the scope ``series`` in it. Predicates on scope, key and value
    reach the files of every part.
    """
    state = load(spark, base)
    parts, tail = _ids(state, "attribute_index"), _not_indexed(state)
    rows = _index_rows(spark, base, parts).filter(F.col("scope") != INDEXED)
    if not tail and len(parts) <= 1:
        return rows.select("scope", "key", "value", "SeriesID")
    later = _index_rows(spark, base, parts[1:]).filter(F.col("scope") == INDEXED).select("SeriesID", "write")
    if not tail:
        return _current(rows, later)
    fresh = compact_series(read_writes(spark, f"{base}/series", tail, SERIES))
    newest = fresh.select("SeriesID", F.lit(2**63 - 1).alias("write"))
    return _current(rows, later.unionByName(newest)).unionByName(attribute_index(fresh))


# ---------------------------------------------------------------- maintenance


def optimize_series(spark: SparkSession, base: str, keep_first_seen: bool = False) -> None:
    """Rewrite the catalogue as it is to one row per series.

    The result takes over from the writes that it was made of and from no others, so what is stored
    meanwhile stays. With one write there is nothing to do. A store with an attribute index has
    the new series indexed first: the index of the merged writes then covers the result.
    """
    if live(load(spark, base), "attribute_index"):
        write_attribute_index(spark, base)
    state = load(spark, base)
    covered = {n for w in live(state, "attribute_index") for n in w["covers"]}
    ids = [n for n in _ids(state, "series") if not covered or n in covered]
    if len(ids) < 2:
        return
    write_id = new_write_id()
    rows = compact_series(read_writes(spark, f"{base}/series", ids, SERIES), keep_first_seen)
    found = put_series(rows, base, write_id)

    def take_over(state: dict) -> None:
        manifest.replace(state, "series", ids, write_id, found["series"])
        for part in live(state, "attribute_index"):
            if set(part["covers"]) & set(ids):
                part["covers"] = [n for n in part["covers"] if n not in ids] + [write_id]

    commit(spark, base, take_over)


def merge_points(spark: SparkSession, base: str, table: str) -> None:
    """H7: rewrite the points of a type that came since the last merge into few large files.

    Streaming leaves small files, one set per micro-batch. Merged ones are not rewritten.
    The result takes over from the writes it was made of and from no others. With one
    write there is nothing to do.
    """
    ids = [w["id"] for w in live(load(spark, base), table) if not w.get("merged")]
    if len(ids) < 2:
        return
    write_id = new_write_id()
    found = put_points({table: read_points(spark, base, table, ids)}, base, write_id, by_range=True)
    commit(spark, base, lambda s: manifest.replace(s, table, ids, write_id, found[table]))


def _put_index(rows: DataFrame, base: str, write_id: int) -> dict[str, int]:
    """Index rows by scope, sorted by key and value.

    Range partitioning ends in SeriesID, so a value shared by every series is split over tasks too.
    """
    order = ("scope", "key", "value", "SeriesID")
    return put_rows(
        rows.repartitionByRange(*order).sortWithinPartitions(*order),
        f"{base}/attribute_index/write={write_id}",
        {"attribute_index": F.count(F.lit(1))},
        ("scope",),
    )


def write_attribute_index(spark: SparkSession, base: str) -> None:
    """Index the writes of the catalogue that came since the last time, and only those.

    They become a new part, beside the ones that are there. Without such a write nothing is done.
    """
    ids = _not_indexed(load(spark, base))
    if not ids:
        return
    write_id = new_write_id()
    series = compact_series(read_writes(spark, f"{base}/series", ids, SERIES))
    none = F.lit("")
    own = series.select(F.lit(INDEXED).alias("scope"), none.alias("key"), none.alias("value"), "SeriesID")
    found = _put_index(attribute_index(series).unionByName(own), base, write_id)

    def add(state: dict) -> None:
        later = [w["id"] for w in live(state, "attribute_index") if w["id"] > write_id]
        if later or not set(ids) <= set(_not_indexed(state)):
            raise manifest.Replaced("some of the series have been indexed or merged meanwhile")
        if found:
            state["writes"].append({"id": write_id, "tables": found, "holds": {}, "covers": ids})

    commit(spark, base, add)


def merge_attribute_index(spark: SparkSession, base: str) -> None:
    """Rewrite the parts of the index to one. With one part there is nothing to do."""
    parts = live(load(spark, base), "attribute_index")
    if len(parts) < 2:
        return
    ids, write_id = [p["id"] for p in parts], new_write_id()
    rows = _index_rows(spark, base, ids)
    own = rows.filter(F.col("scope") == INDEXED)
    later = own.filter(F.col("write") != ids[0]).select("SeriesID", "write")
    merged = _current(rows.filter(F.col("scope") != INDEXED), later)
    names = own.select("scope", "key", "value", "SeriesID").distinct()
    found = _put_index(merged.unionByName(names), base, write_id)

    def take_over(state: dict) -> None:
        parts = live(state, "attribute_index")
        if [p["id"] for p in parts] != ids:  # a part's number says which rows are newer
            raise manifest.Replaced("the index has got another part meanwhile")
        covers = [n for p in parts for n in p["covers"]]
        manifest.replace(state, "attribute_index", ids, write_id, found["attribute_index"], covers=covers)

    commit(spark, base, take_over)


def remove_superseded(spark: SparkSession, base: str) -> list[str]:
    """Remove the folders that the manifest says a later write has taken over, and name them.

    No other folder is touched, whatever its number. Run it when no query that began
    before the merge is still running.
    """
    retired = load(spark, base)["retired"]
    paths = [_retired_path(base, table, write_id) for table, write_id in retired]
    for path in paths:
        files.delete(spark, path)

    def forget(state: dict) -> None:
        state["retired"] = [r for r in state["retired"] if r not in retired]

    if retired:
        commit(spark, base, forget)
    return paths


def _retired_path(base: str, table: str, write_id: int) -> str:
    if table in POINTS:
        return f"{base}/points/write={write_id}/table={table}"
    return f"{base}/{table}/write={write_id}"
