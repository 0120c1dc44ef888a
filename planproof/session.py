"""Session settings that the engine relies on, all settable at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    """The caller's session with the settings; partition counts and memory stay the caller's."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local(cores: int | str = "*", memory: str = "4g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("planproof").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
