"""Session settings, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: settings worth having on any cluster; sizes are left to the cluster's own configuration
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # no stack trace per column expression: compiling a mapping makes many of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: the same for a session that began without a checkpoint folder, such as a local one
WORK_SETTING = "spark.loomrow.workDir"


def get_session(app_name: str = "loomrow", master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's settings; ``settings`` override them by their full names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str | None:
    """The shared folder for intermediate tables, if one is set."""
    return spark.sparkContext.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(WORK_SETTING, None)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing folder for a written intermediate table.

    Lies below the folder the session names in ``spark.checkpoint.dir``, which all executors must share.
    """
    root = work_root(spark)
    if not root:
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that driver and executors share")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex[:12]}"
