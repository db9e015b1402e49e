"""Session settings, in one place."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that may change in a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def configure(spark: SparkSession, **more: str) -> SparkSession:
    """Set what can be set on a session that someone else has started."""
    for key, value in (RUNTIME | more).items():
        spark.conf.set(key, value)
    return spark


def start(name: str = "colonnade", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map={"spark.ui.showConsoleProgress": "false"} | RUNTIME | more)
    return (builder.master(master) if master else builder).getOrCreate()
