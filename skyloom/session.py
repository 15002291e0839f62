"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Grids travel to Python as whole arrays (a 400x400 frame is 640 KB), so Arrow
# batches are bounded by bytes and not only by row count.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # top-n per entity is cut per map task up to this n
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def workspace(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local master that names none (tests) gets a temporary folder, set as the checkpoint
    folder of the session; a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skyloom-")
        context.setCheckpointDir(base)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/skyloom/{purpose}-{uuid.uuid4().hex}"
