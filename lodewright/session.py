"""A session with the settings that the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "lodewright", **conf: str) -> SparkSession:
    """Adaptive plans, Arrow transfer and UTC; ``master`` and any other setting are left to the cluster unless given.

    Shuffles start with 2000 partitions, which are coalesced at run time, so that one setting serves small and large inputs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (own | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
