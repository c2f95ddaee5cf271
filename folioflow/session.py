"""Session settings that every job here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "folioflow", **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution on; ``conf`` overrides single settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
