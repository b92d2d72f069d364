"""New paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder for a local master, and an error for any other."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="millrace-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
