"""Archive queries by local day over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import listing as L
from tidewire.plans.registry import query
from tidewire.plans.stand_ins import table


@query(
    "archive_days",
    "SELECT CAST(CAST(ts + INTERVAL 10 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1",
)
def archive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return L.per_day(events, "ts").withColumn("day", F.col("day").cast("string"))
