"""Session settings every job expects."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when an aggregate on the same key follows
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | None = None, app: str = "rokad") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("ROKAD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
