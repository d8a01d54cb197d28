"""Small files of the driver on whatever storage a path is on."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """A path and its Hadoop file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def make_folder(spark: SparkSession, path: str) -> None:
    where, files = place(spark, path)
    files.mkdirs(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; false if there is none."""
    where, files = place(spark, path)
    return files.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, by one call; none if there is no such folder."""
    where, files = place(spark, path)
    try:
        return [status.getPath().getName() for status in files.listStatus(where)]
    except Py4JJavaError as error:
        if _is(error, "FileNotFoundException"):
            return []
        raise


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file; None if there is no such file."""
    where, files = place(spark, path)
    try:
        stream = files.open(where)
    except Py4JJavaError as error:
        if _is(error, "FileNotFoundException"):
            return None
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file; one that is there is replaced."""
    where, files = place(spark, path)
    stream = files.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file, in one step; false if the target is there, which is then left alone."""
    jvm = spark._jvm
    old, _ = place(spark, source)
    new, files = place(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), files.getConf())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(old, new, spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError as error:
        if _is(error, "FileAlreadyExistsException"):
            return False
        raise
    return True


def move(spark: SparkSession, targets: dict[str, str]) -> None:
    """Rename files or folders of one file system, each to a path that is not there."""
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    for k, (source, target) in enumerate(targets.items()):
        if not k:
            _, files = place(spark, source)
        if not files.rename(new_path(source), new_path(target)):
            raise OSError(f"{source} could not be renamed to {target}")


def _is(error: Py4JJavaError, name: str) -> bool:
    return error.java_exception.getClass().getSimpleName() == name
