"""Spark sessions for local work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine.  On a cluster use the session that is there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brookloom")
        .config("spark.driver.memory", os.environ.get("BROOKLOOM_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
