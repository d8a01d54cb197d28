"""Helpers shared by the operators: tables, stored intermediates, Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metricloom.session import scratch_path

# Bytes of one Arrow batch between the JVM and a Python worker. Texts of a batch
# are held several times over (bytes, hashes), so the batch is kept small.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it again.

    Cuts the lineage: what follows neither recomputes the frame nor depends on
    the executors that made it.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    added(frame, path)
    return spark.read.schema(frame.schema).parquet(path)


def added(frame: DataFrame, path: str) -> None:
    """Write a frame beside what a folder holds."""
    # The shuffle files of the write go with its end, not whenever the driver collects garbage.
    with settings(frame.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        frame.write.mode("append").parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs run inside, put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def path_of(spark: SparkSession, path: str):
    """A path and its Hadoop file system, whatever storage it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def dropped(frame: DataFrame) -> None:
    """Remove the files of a ``stored`` frame that nothing reads any more."""
    for file in frame.inputFiles()[:1]:
        place, files = path_of(frame.sparkSession, file)
        files.delete(place.getParent(), True)


@lru_cache(maxsize=2)
def _ship(application: str) -> None:
    """Give executors this package, which the driver may have found by a path of its own."""
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    SparkSession.active().sparkContext.addPyFile(str(archive))


def map_batches(
    frame: DataFrame,
    step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so a run of long texts fits in memory."""
    _ship(frame.sparkSession.sparkContext.applicationId)
    conf = frame.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame.mapInArrow(step, schema)


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, as the length of the text; null for a null text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def rows(**columns) -> pa.RecordBatch:
    """A batch from lists, numpy arrays or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()],
        names=list(columns),
    )


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, the only ones Spark has."""
    return values.view(np.int64)
