"""Session factory with the settings the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "tideline", checkpoint_dir: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; settings that are already given by spark-submit stay.

    checkpoint_dir is the folder that driver and executors share (spark.checkpoint.dir); a running session refuses another.
    """
    cores = os.cpu_count() or 8
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("TIDELINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
