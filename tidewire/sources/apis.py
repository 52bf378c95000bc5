"""JSON interfaces as DataFrames: parsed by schema in the JVM, one row per post or posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import find_date
from tidewire.functions.html import strip_html
from tidewire.functions.money import pay_range
from tidewire.functions.text import _udf, clean_text, truncate
from tidewire.functions.urls import IMAGE_FILE, normalize_url

POST = "permalink string, title string, url string, url_overridden_by_dest string, selftext_html string, author string, created_utc double, over_18 boolean, removed_by_category string"
POSTS = f"struct<data: struct<children: array<struct<kind: string, data: struct<{', '.join(f'{n}: {t}' for n, t in (c.split(' ', 1) for c in POST.split(', ')))}>>>>>"
SUMMARY = 400


def parse_posts(pages: DataFrame, subreddit: str) -> DataFrame:
    """Candidates of a subreddit's listing (url, content): posts that are neither removed nor for adults and have a title."""
    rows = pages.select(F.col("url").alias("page_url"), F.posexplode(F.from_json(F.col("content").cast("string"), POSTS)["data"]["children"]).alias("pos", "c"))
    p = F.col("c.data")
    rows = rows.where((F.col("c.kind") == "t3") & p["permalink"].startswith("/r/") & (clean_text(p["title"]) != "") & (F.coalesce(p["removed_by_category"], F.lit("")) == "") & ~F.coalesce(p["over_18"], F.lit(False)))
    target = F.coalesce(F.nullif(p["url_overridden_by_dest"], F.lit("")), p["url"])
    picture = F.when(F.regexp_replace(target, "[?#].*$", "").rlike(IMAGE_FILE), target)
    author = F.when(~p["author"].isin("", "[deleted]"), F.concat(F.lit("u/"), p["author"]))
    key = normalize_url(F.concat(F.lit("https://www.reddit.com"), p["permalink"]))
    return rows.select("page_url", "pos", key.alias("url"), key.alias("key"), F.lit("feed").alias("via"), clean_text(p["title"]).alias("title"), F.nullif(_udf(strip_html)(p["selftext_html"]), F.lit("")).alias("summary"), picture.alias("image_url"), F.timestamp_seconds(p["created_utc"]).alias("published_at"), author.alias("author"), F.array(F.lit(subreddit)).alias("tags"))


USAJOBS = (
    "struct<SearchResult: struct<SearchResultItems: array<struct<MatchedObjectDescriptor: struct<PositionTitle: string, PositionURI: string, ApplyURI: array<string>, OrganizationName: string, DepartmentName: string, PositionLocationDisplay: string, "
    "PositionLocation: array<struct<LocationName: string>>, PositionRemuneration: array<struct<MinimumRange: string, MaximumRange: string, RateIntervalCode: string>>, PublicationStartDate: string, ApplicationCloseDate: string, QualificationSummary: string, "
    "UserArea: struct<Details: struct<JobSummary: string>>>>>, UserArea: struct<NumberOfPages: string>>>"
)


def short(text: Column) -> Column:
    return F.nullif(truncate(clean_text(text), SUMMARY), F.lit(""))


def parse_usajobs(pages: DataFrame, place: str = "guam", employer: str | None = None, location: str | None = None) -> DataFrame:
    """Postings of answers of the federal search interface (content)."""
    rows = pages.select(F.explode(F.from_json(F.col("content").cast("string"), USAJOBS)["SearchResult"]["SearchResultItems"]).alias("i")).select("i.MatchedObjectDescriptor.*")
    paid = F.filter("PositionRemuneration", lambda x: pay_range(x["MinimumRange"], x["MaximumRange"], x["RateIntervalCode"]).isNotNull())
    first = F.get(paid, F.lit(0))
    places = F.array_join(F.filter(F.transform("PositionLocation", lambda x: x["LocationName"]), lambda x: F.lower(x).contains(place)), "; ")
    filled = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    return rows.select(
        filled(F.col("PositionURI"), F.get("ApplyURI", F.lit(0))).alias("url"), clean_text(F.col("PositionTitle")).alias("title"), filled(F.col("OrganizationName"), F.col("DepartmentName"), F.lit(employer).cast("string")).alias("employer"),
        pay_range(first["MinimumRange"], first["MaximumRange"], first["RateIntervalCode"]).alias("pay"), short(filled(F.col("UserArea.Details.JobSummary"), F.col("QualificationSummary"))).alias("description"),
        filled(places, F.col("PositionLocationDisplay"), F.lit(location).cast("string")).alias("location"), find_date(F.col("PublicationStartDate")).alias("open_date"), find_date(F.col("ApplicationCloseDate")).alias("close_date"),
        *(F.lit(None).cast("string").alias(c) for c in ("close_note", "pdf_url", "detail_url", "reference")),
    )


def pick(row: Column, *names: str) -> Column:
    """The first of these fields of a map that has a value, regardless of case and underscores."""
    plain = F.transform_keys(row, lambda k, v: F.lower(F.replace(k, F.lit("_"), F.lit(""))))
    value = lambda n: F.try_element_at(plain, F.lit(n.replace("_", "").lower()))
    return F.coalesce(*(F.when(~value(n).isin("", "[]"), value(n)) for n in names))


def parse_portal(pages: DataFrame, site: str, api: str, employer: str | None = None, location: str | None = None) -> DataFrame:
    """Postings of a government portal's answers (content): rows whose fields' spelling varies."""
    rows = pages.select(F.explode(F.from_json(F.col("content").cast("string"), "struct<results: array<map<string, string>>>")["results"]).alias("r"))
    r = F.col("r")
    number = pick(r, "ANNOUNCEMENT_ID", "ID")
    title = pick(r, "POSITION_TITLE", "ANNOUNCEMENT_TITLE", "JOB_TITLE")
    close = pick(r, "DATE_CLOSED", "CLOSE_DATE", "CLOSING_DATE", "END_DATE")
    named = F.nullif(clean_text(pick(r, "DEPARTMENT_NAME", "DEPARTMENT", "AGENCY", "AGENCY_NAME")), F.lit(""))
    pay = F.coalesce(clean_text(pick(r, "SALARY_RANGE", "SALARY", "PAY_RANGE", "PAY_GRADE")), F.lit(""))
    bounds = pay_range(pick(r, "MIN_SALARY", "SALARY_MIN", "MINIMUM_SALARY", "SALARY_FROM"), pick(r, "MAX_SALARY", "SALARY_MAX", "MAXIMUM_SALARY", "SALARY_TO"), F.lit(None).cast("string"))
    return rows.where(number.isNotNull() & title.isNotNull()).select(
        F.concat(F.lit(f"{site}#announcement-"), number).alias("url"), clean_text(title).alias("title"), F.coalesce(named, F.lit(employer).cast("string")).alias("employer"), F.coalesce(F.nullif(pay, F.lit("")), bounds).alias("pay"),
        short(_udf(strip_html)(pick(r, "NATURE_OF_WORK", "DUTIES", "JOB_DESCRIPTION", "DESCRIPTION", "SUMMARY"))).alias("description"), F.coalesce(clean_text(pick(r, "WORK_LOCATION", "LOCATION", "DUTY_STATION")), F.lit(location).cast("string")).alias("location"),
        find_date(pick(r, "DATE_OPENED", "OPEN_DATE", "START_DATE", "DATE_POSTED")).alias("open_date"), find_date(close).alias("close_date"), F.when(close.isNull(), F.lit("Open until filled")).alias("close_note"), F.lit(None).cast("string").alias("pdf_url"),
        F.concat(F.lit(f"{api}?id="), number).alias("detail_url"), number.alias("reference"),
    )


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)
