"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Requests are landed as Parquet, which is reported beside the total, and ingested
once before the other timings. Each query runs once to warm up, then three times, and
its median counts. The streaming query runs once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import metricloom as ml  # noqa: E402
from metricloom.session import SETTINGS, scratch_path  # noqa: E402
from workload import queries as q  # noqa: E402
from workload.store import INGEST_TIMES, landed, stored  # noqa: E402

RUNS = 3


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.monotonic()
    action()
    return time.monotonic() - started


def median(action) -> float:
    action()
    return statistics.median(timed(action) for _ in range(RUNS))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    landing = timed(lambda: landed(spark, sf_dir))  # makes the input; no query
    times = {"ingest_two_batches": timed(lambda: stored(spark, sf_dir))}
    files, base = f"{landed(spark, sf_dir)}/*", stored(spark, sf_dir)

    def flat(table):
        return ml.flatten_metrics(ml.read_requests(spark, files, "parquet", [table]))

    def points(table):
        return ml.scan_points(spark, base, table)

    catalogue = ml.scan_series(spark, base)
    host = ml.attribute_predicate("resource", "host.name", "h1")
    ml.write_attribute_index(spark, base)
    sums = ml.series_rows(ml.map_sum(flat("sum")), INGEST_TIMES[0])
    ids = q._series_ids(spark, sf_dir)
    timings = {
        "flatten_gauge": lambda: run(ml.slim(ml.map_gauge(flat("gauge")), "gauge")),
        "flatten_sum": lambda: run(ml.slim(ml.map_sum(flat("sum")), "sum")),
        "compact_series": lambda: run(ml.compact_series(sums)),
        "new_series": lambda: run(
            # Against the catalogue of the first batch.
            ml.new_series(sums, catalogue.filter(F.col("FirstSeen") == INGEST_TIMES[0]))
        ),
        "enrich_gauge": lambda: run(ml.enrich(points("gauge"), catalogue)),
        "enrich_sum": lambda: run(ml.enrich(points("sum"), catalogue)),
        "attribute_scan": lambda: run(
            ml.points_where(points("gauge"), ml.compact_series(catalogue), host)
        ),
        "attribute_index": lambda: run(
            ml.points_of(
                points("gauge"),
                ml.indexed_series(
                    ml.scan_attribute_index(spark, base), "resource", "host.name", "h1"
                ),
            )
        ),
        "series_over_time": lambda: run(
            ml.series_over_time(points("gauge"), ids, q.RANGE_START, q.RANGE_END)
        ),
        "count_points": lambda: run(
            ml.count_points(points("sum"), ml.compact_series(catalogue), F.lit(True))
        ),
    }
    for name, action in timings.items():
        times[name] = median(action)
    # The fixed cost of a batch: a thousand points of one type.
    few = scratch_path(spark, "bench-few")
    ml.land_requests(ml.read_requests(spark, files, "parquet").limit(1000), f"{few}/landed")
    small = iter(range(100))
    timings_of_few = [
        timed(lambda: ml.ingest_files(spark, f"{few}/landed", few, next(small), INGEST_TIMES[0]))
        for _ in range(RUNS)
    ]
    times["ingest_small_batch"] = statistics.median(timings_of_few)
    out = scratch_path(spark, "bench-stream")
    stream = ml.stream_requests(spark, files, "parquet")
    times["streaming_ingest"] = timed(lambda: ml.drain(stream, out, f"{out}/checkpoint"))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in times.items()},
                "land_requests": round(landing, 3),
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
