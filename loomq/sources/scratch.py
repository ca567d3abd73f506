"""Folders that the driver and all executors see."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..errors import LoomError


def shared_folder(spark: SparkSession) -> str:
    """A new, empty folder name under spark.checkpoint.dir, or else under the context's checkpoint folder.

    Where neither is set, a master on this machine gets a folder under /tmp/checkpoints; on a cluster that is an error, as
    executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise LoomError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomq-{uuid.uuid4().hex}"
