"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "premia", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for this engine; on a cluster pass ``master=None`` and size
    ``shuffle_partitions`` to the data (AQE coalesces small partitions at run time)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.driver.memory": "8g",
        # Python call-site capture costs several JVM round trips per Column call
        # while a plan is built; plans here are built from many small expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master, whose driver and executors are one process, may go without
    the setting; it gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is not set: written tables need a folder that all executors share")
        # a running session refuses the setting itself, so its context holds the folder
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"premia-{spark.sparkContext.applicationId}"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/premia/{name}-{uuid.uuid4().hex[:12]}"
