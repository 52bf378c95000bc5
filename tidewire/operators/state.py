"""Keyed state: every update is a join, whose result `versions` stores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.versions import BucketedTable, Conflict, VersionedTable

__all__ = ["BucketedTable", "Conflict", "VersionedTable"]


def numbered(rows: DataFrame, group: Column, order: list[Column], start: int, out: str = "id") -> DataFrame:
    """rows with a gapless number above `start`, in order of group and then `order`. Rows meet within their group only; of groups only counts meet."""
    keyed = rows.withColumn("_group", group)
    counts = keyed.groupBy("_group").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_group").alias("_g"), before.alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
    return ranked.join(offsets, F.col("_group").eqNullSafe(F.col("_g"))).withColumn(out, F.lit(start) + F.col("_before") + F.col("_rank")).drop("_group", "_g", "_before", "_rank")


def greatest(rows: DataFrame, column: str = "id") -> int:
    """The greatest number in a column, 0 of none: one number for the driver."""
    return rows.agg(F.max(column).alias("top")).first()["top"] or 0


def upserted(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those with their key; of several new rows the last by `order` counts, and of those that tie, or without an order, the greatest by all columns."""
    plain = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in new.dtypes]
    last = Window.partitionBy(key).orderBy(*([order.desc_nulls_last()] if order is not None else []), F.struct(*plain).desc())
    one = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return old.join(one.select(key), key, "left_anti").unionByName(one.select(*old.columns))


def remembered(seen: DataFrame, outcomes: DataFrame, now: dt.datetime) -> DataFrame:
    """seen after a round: every outcome (url, source_id, status, reason) but a throttled one adds an attempt; pages that were stored (status ok) are forgotten.

    Of several outcomes of a URL a rejection stands before a failure; of equal ones the greatest reason is kept.
    """
    at, tried = F.lit(now).cast("timestamp"), F.col("status") != "throttled"
    weight = F.when(F.col("status") == "rejected", 2).when(tried, 1).otherwise(0)
    per_url = outcomes.groupBy("url").agg(F.max(F.struct(weight.alias("weight"), "reason", "status", "source_id")).alias("n"), F.sum(tried.cast("int")).alias("n_tried"), F.bool_or(F.col("status") == "ok").alias("n_stored"))
    both = seen.join(per_url, "url", "full").where(~F.coalesce("n_stored", F.lit(False)) & (F.col("status").isNotNull() | (F.col("n_tried") > 0)))
    use = F.coalesce(F.col("n_tried") > 0, F.lit(False))
    return both.select(
        "url",
        F.coalesce("source_id", "n.source_id").alias("source_id"),
        F.when(use, F.col("n.status")).otherwise(F.col("status")).alias("status"),
        F.when(use, F.substring("n.reason", 1, 500)).otherwise(F.col("reason")).alias("reason"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("n_tried", F.lit(0))).cast("int").alias("attempts"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"),
        F.when(use, at).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
    )


def stored_articles(articles: DataFrame, drafts: DataFrame, now: dt.datetime, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """articles with the accepted drafts, and the outcomes of those that were there already. Ids go on from `start`, or from the greatest of the articles.

    A draft whose URL is stored gives its alias to a row that has none, else it is a rejected duplicate. New ids continue
    in order of arrival (source, pos).
    """
    ok = drafts.where("status = 'ok'")
    first = Window.partitionBy("url").orderBy("source_id", "pos", "key")
    ranked = ok.withColumn("_n", F.row_number().over(first))
    one, again = ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")
    fresh = one.join(articles.select("url"), "url", "left_anti")
    new = numbered(fresh, F.col("source_id"), [F.col("pos"), F.col("key")], greatest(articles) if start is None else start)
    new = new.withColumns({"first_seen_at": F.lit(now).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    kinds = dict(articles.dtypes)
    new = new.select(*(F.col(c).cast(kinds[c]).alias(c) if c in new.columns else F.lit(None).cast(kinds[c]).alias(c) for c in articles.columns))
    known = one.join(articles.select("url", F.col("discovered_url").alias("_alias"), F.lit(True).alias("_there")), "url")
    aliases = known.where("discovered_url IS NOT NULL AND _alias IS NULL").select("url", F.col("discovered_url").alias("_new_alias"))
    rows = articles.join(aliases, "url", "left").withColumn("discovered_url", F.coalesce("discovered_url", "_new_alias")).select(*articles.columns)
    outcome = lambda d: d.select(F.col("key").alias("url"), "source_id", F.lit("rejected").alias("status"), F.lit("duplicate").alias("reason"))
    return rows.unionByName(new), outcome(known.where("discovered_url IS NULL OR _alias IS NOT NULL")).unionByName(outcome(again))


def synced(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """A dimension brought in line with its configuration by slug: changed, added with new ids, or disabled; nothing is deleted."""
    given = [c for c in configured.columns if c != "slug"]
    conf = configured.select("slug", F.lit(True).alias("_there"), *(F.col(c).alias(f"c_{c}") for c in given))
    there = F.col("_there").isNotNull()
    new = {c: F.when(there, F.col(f"c_{c}")).otherwise(F.col(c)) for c in given} | {"enabled": F.coalesce("c_enabled", F.lit(False)) if "enabled" in given else there}
    known = stored.join(conf, "slug", "left").select(*(new.get(c, F.col(c)).alias(c) for c in stored.columns))
    added = numbered(configured.join(stored.select("slug"), "slug", "left_anti"), F.pmod(F.xxhash64("slug"), F.lit(64)), [F.col("slug")], greatest(stored))
    kinds = dict(stored.dtypes)
    return known.unionByName(added.select(*((F.col(c) if c in added.columns else F.lit(True) if c == "enabled" else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns)))


def retained(runs: DataFrame, seen: DataFrame, now: dt.datetime, run_days: int = 180, seen_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Runs and seen pages that are not too old to keep."""
    return runs.where(F.col("started_at") >= F.lit(now - dt.timedelta(days=run_days))), seen.where(F.col("last_attempt_at") >= F.lit(now - dt.timedelta(days=seen_days)))


def changed_pages(fetched: DataFrame, cache: DataFrame) -> DataFrame:
    """Fetched pages (url, http_status, content) that are new or differ from the cached content, with their hash."""
    rows = fetched.where("http_status <> 304").withColumn("content_hash", F.sha2("content", 256))
    return rows.join(cache.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def confined(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """articles with those of single-topic sources in that topic alone. sources has id and only_in_topic."""
    only = sources.where("only_in_topic IS NOT NULL").select(F.col("id").alias("source_id"), "only_in_topic")
    rows = articles.join(only, "source_id", "left")
    return rows.withColumn("categories", F.when(F.col("only_in_topic").isNotNull() & (F.col("categories") != F.array("only_in_topic")), F.array("only_in_topic")).otherwise(F.col("categories"))).select(*articles.columns)
