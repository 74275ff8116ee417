"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def spark_session(app: str = "threadlake", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC clock and adaptive execution; partition sizes are left to AQE unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
