"""Open job postings: listing, boards, and reconciliation of stored postings with a board's new listing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import contains_plain, title_key
from tidewire.operators.listing import Page, paged
from tidewire.operators.state import BucketedTable, greatest, numbered
from tidewire.schemas import SCHEMAS
from tidewire.sources.boards import DETAILS, parse_board, posting_details, with_details


def is_open(today: dt.date) -> Column:
    """Still listed, and not past its closing date if it has one."""
    return F.col("removed_at").isNull() & (F.col("close_date").isNull() | (F.col("close_date") >= F.lit(today)))


def matches(q: str) -> Column:
    """Whether title, employer, location and description together contain q, regardless of case and accents."""
    text = F.concat_ws(" ", "title", "employer", "location", "description")
    return contains_plain(text, q)


def open_jobs(jobs: DataFrame, boards: DataFrame, today: dt.date, q: str = "", source: str | None = None) -> DataFrame:
    """Open postings of enabled boards with their board's name and homepage."""
    dim = boards.where("enabled")
    if source:
        dim = dim.where(F.col("slug") == source)
    rows = jobs.where(is_open(today))
    if q:
        rows = rows.where(matches(q))
    return rows.join(dim.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("homepage").alias("source_homepage")), "source_id")


def list_jobs(jobs: DataFrame, boards: DataFrame, today: dt.date, q: str = "", source: str | None = None, page: int = 1, per_page: int = 30) -> Page:
    """Newest openings first; a posting without an open date counts from when it was first seen."""
    rows = open_jobs(jobs, boards, today, q, source)
    order = [F.coalesce("open_date", F.to_date("first_seen_at")).desc_nulls_first(), F.col("id").desc()]
    return Page(paged(rows, order, page, per_page), rows.count(), page, per_page)


def board_counts(jobs: DataFrame, boards: DataFrame, today: dt.date) -> DataFrame:
    """Every enabled board with the number of its open postings, by name."""
    n = jobs.where(is_open(today)).groupBy("source_id").agg(F.count("*").alias("open"))
    rows = boards.where("enabled").join(n, F.col("id") == F.col("source_id"), "left").drop("source_id")
    return rows.fillna(0, ["open"]).orderBy("name")


#: Columns of a posting that a new listing only fills or replaces by something, never empties.
KEPT_TEXT = ("employer", "pay", "description", "location", "close_note", "pdf_url")
KEPT_DATES = ("open_date", "close_date")


def reconciled(stored: DataFrame, listed: DataFrame, source_id: int, now: dt.datetime, complete: bool = True, start: int | None = None) -> DataFrame:
    """The board's rows of `jobs` after a check: new postings come in, known ones are refreshed, those no longer listed are marked removed.

    stored are all jobs; rows of other boards come back as they are, and a URL that another board holds stays
    there. A check that didn't read the listing to its end (complete=False) removes nothing. Of a URL that is listed twice the
    first by `pos` counts, or without it the least row. New ids go on from `start`, or from the greatest of the stored ones. One full join.
    """
    mine, others = stored.where(F.col("source_id") == source_id), stored.where(F.col("source_id") != source_id)
    first = Window.partitionBy("url").orderBy(*([F.col("pos")] if "pos" in listed.columns else []), F.struct(*(F.col(c) for c in listed.columns if c != "pos")))
    new = listed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(others.select("url"), "url", "left_anti")
    old = mine.select(*(F.col(c).alias(f"old_{c}") for c in mine.columns))
    both = old.join(new, F.col("old_url") == F.col("url"), "full")
    known, there, at = F.col("old_url").isNotNull(), F.col("url").isNotNull(), F.lit(now).cast("timestamp")
    pick = {c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c)).otherwise(F.col(f"old_{c}")) for c in KEPT_TEXT}
    pick |= {c: F.coalesce(F.col(c), F.col(f"old_{c}")) for c in KEPT_DATES}
    pick |= {
        "url": F.coalesce("url", "old_url"),
        "source_id": F.lit(source_id),
        "title": F.when(there, F.col("title")).otherwise(F.col("old_title")),
        "first_seen_at": F.when(known, F.col("old_first_seen_at")).otherwise(at),
        "last_seen_at": F.when(there, at).otherwise(F.col("old_last_seen_at")),
        "removed_at": F.when(there, F.lit(None).cast("timestamp")).otherwise(F.coalesce("old_removed_at", at) if complete else F.col("old_removed_at")),
        "detail_fetched_at": F.coalesce("detail_fetched_at", "old_detail_fetched_at") if "detail_fetched_at" in listed.columns else F.col("old_detail_fetched_at"),
        "id": F.col("old_id"),
    }
    rows = both.select(*(pick[c].cast(dict(mine.dtypes)[c]).alias(c) for c in mine.columns))
    fresh = numbered(rows.where("id IS NULL").drop("id"), F.pmod(F.xxhash64("url"), F.lit(64)), [F.col("url")], greatest(stored) if start is None else start).select(*(F.col(c).cast(dict(mine.dtypes)[c]).alias(c) for c in mine.columns))
    return others.unionByName(rows.where("id IS NOT NULL")).unionByName(fresh)


def needs_detail(listed: DataFrame, stored: DataFrame, limit: int = 40) -> DataFrame:
    """Listed postings whose detail page is still to be read, at most `limit` a check, in listed order (column pos)."""
    read = stored.where("detail_fetched_at IS NOT NULL").select("url")
    return listed.where("detail_url IS NOT NULL").join(read, "url", "left_anti").orderBy("pos").limit(limit)


def paired_with_pdfs(postings: DataFrame) -> DataFrame:
    """Postings of a board that lists some twice: in a portal (with a reference) and as a PDF.

    A PDF goes to the portal's posting of the number in front of its title, or else to the one of the same
    title if only one has it; PDFs that match none stay. A number has three digits, a hyphen and two digits or more; of postings that share one the
    least url has it.
    """
    portal = postings.where("reference IS NOT NULL").withColumn("_key", title_key(F.col("title"))).withColumn("_alone", F.count("*").over(Window.partitionBy("_key")) == 1)
    pdfs = postings.where("reference IS NULL AND pdf_url IS NOT NULL").withColumn("_num", F.regexp_extract("title", r"^\s*(\d{3}-\d{2,})\b", 1)).withColumn("_key", title_key(F.col("title")))
    numbers = portal.select(F.col("reference").alias("_num"), "url").groupBy("_num").agg(F.min("url").alias("_by_number"))
    titles = portal.where("_alone").select("_key", F.col("url").alias("_by_title"))
    twins = pdfs.join(numbers, "_num", "left").join(titles, "_key", "left").withColumn("_twin", F.coalesce("_by_number", "_by_title"))
    given = twins.where("_twin IS NOT NULL").groupBy(F.col("_twin").alias("url")).agg(F.min("pdf_url").alias("_pdf"))
    merged = portal.join(given, "url", "left").withColumn("pdf_url", F.coalesce("pdf_url", "_pdf"))
    others = postings.where("reference IS NULL AND pdf_url IS NULL")
    return merged.select(*postings.columns).unionByName(twins.where("_twin IS NULL").select(*postings.columns)).unionByName(others)


def check_board(spark: SparkSession, folder: str, kind: str, pages: DataFrame, source_id: int, now: dt.datetime, complete: bool = True, employer: str | None = None, location: str | None = None, details: DataFrame | None = None) -> int:
    """Reads a board's pages (url, content) and brings the stored jobs of a folder in line with them; how many jobs there are then.

    details (url, content) are postings' own pages that were read; what they add is merged by the board's kind, and a posting whose page was read is marked so.
    """
    table = BucketedTable(spark, f"{folder.rstrip('/')}/jobs", SCHEMAS["jobs"], "url")
    with table.exclusive():
        listed = parse_board(pages, kind, employer, location)
        if kind == "university":
            listed = paired_with_pdfs(listed)
        if details is not None and kind in DETAILS:
            known = details.select(F.col("url").alias("_read")).distinct()
            listed = with_details(listed, posting_details(details.dropDuplicates(["url"]), kind), kind)
            listed = listed.join(known, F.col("url") == F.col("_read"), "left").withColumn("detail_fetched_at", F.when(F.col("_read").isNotNull(), F.lit(now).cast("timestamp"))).drop("_read")
        stored = table.read()
        start = greatest(stored)
        touched = listed.select("url").unionByName(stored.where(F.col("source_id") == source_id).select("url")).distinct()

        def apply(old: DataFrame, urls: DataFrame) -> DataFrame:
            return reconciled(old, listed, source_id, now, complete, start)

        table.merge(touched, apply)
    return table.read().count()
