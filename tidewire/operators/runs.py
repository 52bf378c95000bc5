"""The log of runs: a row per source and run, opened before and closed after it, and what runs found."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.state import greatest, numbered

COUNTS = ("candidates", "new_articles", "failed")


def opened(runs: DataFrame, source_ids: DataFrame, now: dt.datetime) -> DataFrame:
    """runs with an open row, without an end, for every source_id."""
    fresh = numbered(source_ids.select("source_id").distinct(), F.lit(0), [F.col("source_id")], greatest(runs)).withColumn("started_at", F.lit(now).cast("timestamp"))
    kinds = dict(runs.dtypes)
    return runs.unionByName(fresh.select(*((F.col(c) if c in fresh.columns else F.lit(0) if c in COUNTS else F.lit(None)).cast(kinds[c]).alias(c) for c in runs.columns)))


def closed(runs: DataFrame, results: DataFrame, now: dt.datetime) -> DataFrame:
    """runs with the newest open row of each source of results (source_id, candidates, new_articles, failed, error) ended."""
    newest = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id")))
    mine = runs.where("finished_at IS NULL").withColumn("_n", newest).where("_n = 1").select("id", "source_id").join(results, "source_id").drop("source_id")
    mine = mine.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in (*COUNTS, "error")))
    hit = F.col("_id").isNotNull()
    both = runs.join(mine, runs["id"] == mine["_id"], "left")
    new = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in (*COUNTS, "error")} | {"finished_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("finished_at"))}
    kinds = dict(runs.dtypes)
    return both.select(*(new.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in runs.columns))


def totals(runs: DataFrame) -> DataFrame:
    """Per start of a run the number of sources and the sums of what they found."""
    return runs.groupBy("started_at").agg(F.count("*").alias("sources"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), F.count("error").alias("errors"))


def by_path(candidates: DataFrame) -> DataFrame:
    """How many candidates each way of discovery gave."""
    return candidates.groupBy("via").agg(F.count("*").alias("n"))
