"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession

# Settings the engine is tuned for. All are session settings: a cluster that
# sets its own values keeps them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# Requests take many times the work of their bytes, which compress well: a task gets few of them.
INPUT_SPLITS = {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "512k"}


@contextmanager
def input_splits(spark: SparkSession) -> Iterator[None]:
    """Small tasks for passes over request files, unless the session has sizes of its own."""
    own = {k: v for k, v in INPUT_SPLITS.items() if k not in spark.conf.getAll}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """A folder of this machine, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="metricloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A
    local one is made only where that is unset and driver and executors are one process;
    on a cluster without a shared folder this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a shared folder")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/metricloom/{name}-{uuid.uuid4().hex}"
