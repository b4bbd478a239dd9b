"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a skewed join is worth one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Masters whose driver and executors are one process and so share a local folder.
ONE_PROCESS = re.compile(r"local(\[.*\])?")


def build_session(app_name: str = "rolewatch", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a session of one process (tests) gets a temporary folder;
    on a cluster that is an error, as no other machine could read a folder of the driver.
    """
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured and not ONE_PROCESS.fullmatch(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="rolewatch-"))
