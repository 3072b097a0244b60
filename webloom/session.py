"""A session with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int = 8) -> SparkSession:
    """The active session, or a local one; on a cluster, pass settings to ``spark-submit`` instead."""
    return (
        SparkSession.builder.master(master or os.environ.get("WEBLOOM_MASTER", "local[8]"))
        .appName("webloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", os.environ.get("WEBLOOM_WAREHOUSE", os.path.join(os.getcwd(), "spark-warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
