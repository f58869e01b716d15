"""Folders for working tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors share one: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weekloom-")
    return f"{root.rstrip('/')}/weekloom-{uuid.uuid4().hex}/{name}"
