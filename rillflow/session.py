"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "rillflow", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and the RocksDB state store; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
