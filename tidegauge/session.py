"""Session settings shared by the queries."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of a batch that goes to a Python worker: rows hold whole texts or sets, and two copies are in memory.
ARROW_ROWS = 1000
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, bound their batches, and pin what results depend on (UTC days)."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def local_session(cores: str | int = "*", memory: str = "10g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegauge")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
