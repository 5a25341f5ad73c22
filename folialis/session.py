"""Session helpers: a local session for tests, and settings every session needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings for a session of our own. A cluster's own settings are left alone.
LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "6g", **more: str) -> SparkSession:
    """A session on this machine for tests and benches."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("folialis").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**LOCAL_SETTINGS, **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()
