"""A session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's settings hold and only the time zone and AQE matter."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusloom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.legacy.javaCharsets": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
