"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Python data sources that push filters don't load without it.
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
