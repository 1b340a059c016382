"""A local session with settings that fit a cluster too."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", partitions: int = 8, name: str = "plumbline") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
