"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder only where that is unset and the master is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="corpusloom-"))
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
