"""The folder that the driver and all executors share, for tables between steps and state of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder.

    The cluster names that folder in spark.checkpoint.dir. Only where it is unset in a local
    session, as in tests, a temporary folder stands in for it; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fieldloom.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("fieldloom.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
