"""Sessions for tests, benchmarks and scripts; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "trellis") -> SparkSession:
    """A session on this machine, with adaptive execution and UTC."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRELLIS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", os.environ.get("TRELLIS_WAREHOUSE", tempfile.mkdtemp(prefix="trellis-")))
        .config("spark.sql.legacy.parquet.nanosAsLong", "false")
        .getOrCreate()
    )
