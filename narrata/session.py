"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "narrata", master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and benches; on a cluster pass the session that the cluster made."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
