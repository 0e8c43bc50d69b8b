"""Sessions with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow transfer; conf overrides."""
    b = SparkSession.builder.appName("sextant")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=settings | conf).getOrCreate()
