"""Where intermediate tables and streaming checkpoints may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names.

    Executors share that folder, so what is written there outlives any of them.
    Only a local master may fall back to a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barscreen-")
    return f"{base.rstrip('/')}/barscreen-{uuid.uuid4().hex}/{name}"
