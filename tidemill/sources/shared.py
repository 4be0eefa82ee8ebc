"""Folders that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def own_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one that was set for checkpoints.

    Only where neither is set and driver and executors are one process (tests) one is made and set; on a
    cluster a folder of this machine would be unseen by the executors, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and found.isDefined():
        return found.get().rstrip("/")
    if not root:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
