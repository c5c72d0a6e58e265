"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in spark.checkpoint.dir; only where that is unset, as in tests, in a local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumisift-"))
        path = spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/lumisift-{uuid.uuid4().hex}"
