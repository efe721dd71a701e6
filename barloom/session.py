"""What queries need of a session."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; without that setting an error on a
    cluster, below /tmp in local mode."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if home is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = "/tmp/checkpoints"
    return f"{home.rstrip('/')}/{name}-{uuid4().hex}"
