"""One session builder for scripts, benches and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "verisieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the time zone fixed.

    Cluster deployments pass their own master and sizes; the defaults only suit a
    single machine.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
