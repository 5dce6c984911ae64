"""Folders that all executors share, for tables that cut a lineage and for files that are written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a session on this machine alone (tests) gets a temporary
    folder, and a session on a cluster an error: its executors would each write
    to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[context.applicationId]


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below ``shared_root``."""
    return f"{shared_root(spark)}/tidegauge/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table of the shared folder: its lineage ends there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
