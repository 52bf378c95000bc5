"""The library's tables, made of the test tables: the same rows by DataFrame and by SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 2, 1, 12, tzinfo=dt.UTC)
TODAY = dt.date(2024, 2, 1)

ARTICLES_SQL = """
articles AS (SELECT doc_id AS id, CAST(substr(source, 4) AS INT) AS source_id, 'https://www.example.com/' || source || '/' || doc_id AS url,
  string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2] AS intro, lang AS section,
  CASE WHEN n_chars % 3 = 0 THEN [lang] WHEN n_chars % 3 = 1 THEN [lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END] ELSE CAST([] AS VARCHAR[]) END AS categories,
  CASE WHEN n_chars % 5 > 0 THEN 'https://img.example.com/' || n_chars % 40 || '.jpg' END AS image_url,
  TIMESTAMP '2024-01-01' + to_seconds(doc_id * 3607) AS published_at, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 3607 + n_chars) AS first_seen_at FROM documents)"""
SOURCES_SQL = """
sources AS (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS id, source AS slug, upper(source) AS name, 'https://' || source || '.example.com' AS homepage,
  CAST(substr(source, 4) AS INT) % 4 <> 3 AS enabled, TIMESTAMP '2024-02-01' + to_minutes(CAST(substr(source, 4) AS INT)) AS last_run_at FROM documents
  UNION ALL SELECT 99, 'silent', 'SILENT', 'https://silent.example.com', true, CAST(NULL AS TIMESTAMP))"""
JOBS_SQL = """
jobs AS (SELECT p_partkey AS id, p_size % 5 AS source_id, 'https://jobs.example.com/' || p_partkey AS url, p_name AS title, p_brand AS employer, CAST(NULL AS VARCHAR) AS description, p_type AS location,
  CASE WHEN p_partkey % 7 > 0 THEN DATE '2024-01-01' + CAST(p_partkey % 45 AS INT) END AS open_date, CASE WHEN p_partkey % 3 > 0 THEN DATE '2024-01-20' + CAST(p_partkey % 40 AS INT) END AS close_date,
  TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 700 AS INT)) AS first_seen_at, CASE WHEN p_partkey % 11 = 0 THEN TIMESTAMP '2024-01-30' END AS removed_at FROM part),
boards AS (SELECT s AS id, 'board' || s AS slug, 'Board ' || s AS name, 'https://board' || s || '.example.com' AS homepage, s <> 2 AS enabled FROM (VALUES (0), (1), (2), (3), (4), (7)) AS v(s))"""
STORIES = "WITH " + ARTICLES_SQL.strip() + ", " + SOURCES_SQL.strip()
JOBS = "WITH " + JOBS_SQL.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(1704067200) + seconds)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines, third = F.split("text", "\n"), F.col("n_chars") % 3
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    return d.select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 9).cast("int").alias("source_id"), F.concat(F.lit("https://www.example.com/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.get(lines, F.lit(0)).alias("title"), F.get(lines, F.lit(1)).alias("intro"), F.col("lang").alias("section"),
        F.when(third == 0, F.array("lang")).when(third == 1, F.array("lang", size)).otherwise(F.array().cast("array<string>")).alias("categories"),
        F.when(F.col("n_chars") % 5 > 0, F.concat(F.lit("https://img.example.com/"), (F.col("n_chars") % 40).cast("string"), F.lit(".jpg"))).alias("image_url"),
        _at(F.col("doc_id") * 3607).alias("published_at"), _at(F.col("doc_id") * 3607 + F.col("n_chars")).alias("first_seen_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.substring("source", 4, 9).cast("int")
    rows = s.select(n.alias("id"), F.col("source").alias("slug"), F.upper("source").alias("name"), F.concat(F.lit("https://"), "source", F.lit(".example.com")).alias("homepage"), (n % 4 != 3).alias("enabled"), F.timestamp_seconds(F.lit(1706745600) + n * 60).alias("last_run_at"))
    silent = spark.createDataFrame([(99, "silent", "SILENT", "https://silent.example.com", True, None)], rows.schema)
    return rows.unionByName(silent)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    day = lambda start, n: F.date_add(F.lit(start), n.cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (F.col("p_size") % 5).alias("source_id"), F.concat(F.lit("https://jobs.example.com/"), k.cast("string")).alias("url"), F.col("p_name").alias("title"), F.col("p_brand").alias("employer"), F.lit(None).cast("string").alias("description"), F.col("p_type").alias("location"),
        F.when(k % 7 > 0, day(dt.date(2024, 1, 1), k % 45)).alias("open_date"), F.when(k % 3 > 0, day(dt.date(2024, 1, 20), k % 40)).alias("close_date"), _at((k % 700) * 3600).alias("first_seen_at"), F.when(k % 11 == 0, F.lit(dt.datetime(2024, 1, 30, tzinfo=dt.UTC))).alias("removed_at"),
    )


def boards(spark: SparkSession) -> DataFrame:
    rows = [(s, f"board{s}", f"Board {s}", f"https://board{s}.example.com", s != 2) for s in (0, 1, 2, 3, 4, 7)]
    return spark.createDataFrame(rows, "id int, slug string, name string, homepage string, enabled boolean")
