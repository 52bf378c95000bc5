"""What leaves the library: sitemap documents, structured data, health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that one sitemap document may have.
MOST_ENTRIES = 50_000


def xml_escape(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def sitemap_entries(times: DataFrame, base: str) -> DataFrame:
    """<url> elements, newest first, of the rows of `sitemap_times`; at most as many as a document may have."""
    path = F.when(F.col("kind") == "all", "/").when(F.col("kind") == "category", F.concat(F.lit("/category/"), "name")).when(F.col("kind") == "source", F.concat(F.lit("/source/"), "name")).otherwise(F.concat(F.lit("/archive/"), F.replace("name", F.lit("-"), F.lit("/"))))
    rows = times.where("newest IS NOT NULL").orderBy(F.desc("newest"), "kind", "name").limit(MOST_ENTRIES)
    loc, stamp = xml_escape(F.concat(F.lit(base.rstrip("/")), path)), F.date_format("newest", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), stamp, F.lit("</lastmod></url>")).alias("value"))


def sitemap_document(times: DataFrame, base: str) -> str:
    """The sitemap as text; its entries are bounded, so the driver can hold them."""
    body = "".join(r["value"] for r in sitemap_entries(times, base).collect())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{body}</urlset>'


def json_ld(value: Column) -> Column:
    """A struct as JSON that can stand inside a script element."""
    text = F.to_json(value)
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def health(sources: DataFrame, now: dt.datetime, stale_hours: int = 6) -> DataFrame:
    """One JSON row: whether any source ran lately, and when."""
    last = sources.agg(F.max("last_run_at").alias("last_run_at"))
    fresh = F.coalesce(F.col("last_run_at") >= F.lit(now - dt.timedelta(hours=stale_hours)), F.lit(False))
    return last.select(F.to_json(F.struct(F.when(fresh, "ok").otherwise("stale").alias("status"), "last_run_at")).alias("value"))


def backup(tables: dict[str, DataFrame], folder: str, stamp: str, keep: int | None = None) -> list[str]:
    """A copy of every table under folder/stamp; of copies that are whole the latest `keep` stay. The stamps that are there. Stamps sort by time."""
    at = folder.rstrip("/")
    for name, rows in tables.items():
        rows.write.parquet(f"{at}/{stamp}/{name}")
    spark = next(iter(tables.values())).sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.createNewFile(path(f"{at}/{stamp}/_whole"))
    there = sorted(f.getPath().getName() for f in fs.listStatus(path(at)) if fs.exists(path(f"{at}/{f.getPath().getName()}/_whole")))
    for old in there[:-keep] if keep else []:
        fs.delete(path(f"{at}/{old}"), True)
    return there[-keep:] if keep else there
