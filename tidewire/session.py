"""The session that the library expects: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "tidewire", **conf: str) -> SparkSession:
    """A session with the library's settings; conf overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what spark.checkpoint.dir names, or in local mode one of our own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewire-"))
            held = context._jsc.sc().getCheckpointDir()
        named = held.get()
    return f"{named.rstrip('/')}/{context.applicationId}"
