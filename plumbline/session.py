"""Session defaults."""

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; other settings are the cluster's."""
    builder = SparkSession.builder.appName("plumbline")
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=defaults | conf).getOrCreate()
