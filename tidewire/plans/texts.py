"""Scalar functions over the test tables: what they get is built of the rows, and so is what they must give, as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import dates as D
from tidewire.functions import fetching
from tidewire.functions import html as H
from tidewire.functions import money as M
from tidewire.functions import text as T
from tidewire.functions import urls as U
from tidewire.operators import ingest as I
from tidewire.plans.registry import query
from tidewire.plans.stand_ins import table

FAR = dt.datetime(2030, 1, 1, tzinfo=dt.UTC)

def K():
    return F.col("doc_id")


def docs(spark, d):
    return table(spark, d, "documents")


def by(n: int, *values, key=None):
    """values[key % n], the last for the rest."""
    key = K() if key is None else key
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(key % n == i, v if not isinstance(v, str) else F.lit(v)) if i == 0 else out.when(key % n == i, v if not isinstance(v, str) else F.lit(v))
    return out.otherwise(values[-1] if not isinstance(values[-1], str) else F.lit(values[-1]))


def joined(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def NUMBER():
    return K().cast("string")


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(coalesce(text, '') || ',x&y;', '[ \n\r\t]+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark, d):
    raw = joined(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("  ​")), "\\,x&amp;y\\;")
    return docs(spark, d).select("doc_id", T.clean_text(raw).alias("clean"))


@query("byline", "SELECT doc_id, CASE WHEN doc_id % 6 <> 1 THEN 'Ann B' || doc_id END AS author FROM documents")
def byline(spark, d):
    name = joined("Ann B", NUMBER())
    raw = by(6, joined(name, ", ", F.upper("source")), joined("The ", F.col("source")), joined(name, " of the ", F.col("source")), joined(name, " | Webmaster"), joined(name, " for Daily ", F.col("source")), name)
    return docs(spark, d).select("doc_id", T.clean_byline(raw, F.col("source"), joined("The Daily ", F.col("source"))).alias("author"))


@query("site_credits", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Ann, Bo' WHEN 1 THEN 'Ann B' || doc_id ELSE '' END AS author FROM documents")
def site_credits(spark, d):
    raw = by(3, "Ann / Site Admin and Bo; Web Designer", joined("Ann B", NUMBER()), "Webmaster")
    return docs(spark, d).select("doc_id", T.without_credits(raw).alias("author"))


@query("headline", "SELECT doc_id, 'Story ' || doc_id || CASE WHEN doc_id % 4 = 3 THEN ' - src' ELSE '' END AS title FROM documents")
def headline(spark, d):
    story = joined("Story ", NUMBER())
    raw = by(4, story, joined(story, " - ", F.col("source")), joined(story, " | ", F.upper("source"), " » ", F.col("source")), joined(story, " - src"))
    return docs(spark, d).select("doc_id", T.headline(raw, F.col("source")).alias("title"))


_SUMMARIES = {  # what a feed says behind a story's own words, and what must be left of them all
    " The post A &amp; B appeared first on Cee.": "",
    "  THE POST Storm over the harbor Appeared First On Island News": "",
    " [&hellip;]": "",
    " [...]": "",
    " […]  ": "",
    " [...] The post A B C appeared first on News.": " [...]",
    " Officials read more than 200 letters before the vote.": " Officials read more than 200 letters before the vote.",
    " Read more books, says the mayor.": " Read more books, says the mayor.",
    " Continue reading to children, teachers ask.": " Continue reading to children, teachers ask.",
    " She left the post after a year.": " She left the post after a year.",
    " The notes [...] were never found.": " The notes [...] were never found.",
    " The comet appeared first on Monday.": " The comet appeared first on Monday.",
    " The post X appeared first on Y": " The post X appeared first on Y",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("feed_summary", f"SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '[ \\t\\r]+', ' ', 'g') || [{', '.join(map(_quoted, _SUMMARIES.values()))}][1 + doc_id % {len(_SUMMARIES)}]) AS summary FROM documents WHERE regexp_full_match(string_split(text, chr(10))[1], '[A-Za-z0-9 ,.!?]*')")
def feed_summary(spark, d):
    """The first lines of the documents, where they are plain, with what feeds and stories say at the end."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    return docs(spark, d).where(line.rlike("^[A-Za-z0-9 ,.!?]*$")).select("doc_id", T.feed_summary(F.concat(line, by(len(_SUMMARIES), *_SUMMARIES))).alias("summary"))


_PARTS = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_GOOD = r"list_filter({}, lambda p: length(p) >= 40 AND NOT starts_with(lower(p), 'photo') AND len(string_split(p, ' | ')) < 3 AND length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) >= CAST(0.55 AS DOUBLE) * length(p))"


def _cut_sql(text: str, n: int) -> str:
    """The SQL of a text cut at n characters, as the query `truncate` has it."""
    h = f"({text})[:{n}]"
    end = lambda m: f"CASE WHEN contains({h}, '{m}') THEN {n} - strpos(reverse({h}), '{m[::-1]}') - {len(m) - 2} ELSE 0 END"
    fin = f"greatest({end('. ')}, {end('.\" ')}, {end('? ')}, {end('! ')})"
    return f"CASE WHEN length({text}) <= {n} THEN {text} WHEN {fin} - 1 >= {n} * 0.6 THEN rtrim({h}[:{fin}]) ELSE rtrim(CASE WHEN contains({h}, ' ') THEN {h}[:{n} - strpos(reverse({h}), ' ')] ELSE {h} END, ' ,;:-–—') || '…' END"


@query("paragraphs", f"SELECT doc_id, array_to_string({_PARTS}, '|') AS parts FROM documents")
def paragraphs(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.paragraphs(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n \n"))), "|").alias("parts"))


@query("good_paragraphs", f"SELECT doc_id, CAST(len({_GOOD.format(_PARTS)}) AS INT) AS n FROM documents")
def good_paragraphs(spark, d):
    odd = F.array(F.lit("Photo courtesy of the harbour office, which took it on Monday morning"), F.lit("By Annabella Maria Bellington-Smith Harbourne"), F.lit("One | Two | Three and a few more words to make it long enough"), F.lit("For immediate release: all of the harbour will be closed tomorrow"), F.lit("short"))
    parts = F.concat(odd, T.paragraphs(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))))
    return docs(spark, d).select("doc_id", F.size(F.filter(parts, T.good_paragraph)).alias("n"))


@query(
    "intro",
    f"""WITH g AS (SELECT doc_id, list_distinct(p) AS u, p FROM (SELECT doc_id, {_GOOD.format(_PARTS)} AS p FROM documents)), o AS (SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i) AS p FROM g),
t AS (SELECT doc_id, p[1] || CASE WHEN len(p) > 1 AND length(p[1]) < 280 THEN chr(10) || chr(10) || p[2] || CASE WHEN len(p) > 2 AND length(p[1]) + length(p[2]) < 280 THEN chr(10) || chr(10) || p[3] ELSE '' END ELSE '' END AS t FROM o)
SELECT doc_id, {_cut_sql('t', 700)} AS intro FROM t""",
)
def intro(spark, d):
    parts = T.paragraphs(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    return docs(spark, d).select("doc_id", T.intro(parts).alias("intro"))


@query("slug", r"SELECT doc_id, rtrim(left(trim(regexp_replace(lower(text[:200]), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-') AS slug FROM documents")
def slug(spark, d):
    return docs(spark, d).select("doc_id", T.slug(F.substring("text", 1, 200)).alias("slug"))


@query("title_keys", "SELECT doc_id, 'clerk ' || doc_id || ' ' || source AS title_key FROM documents")
def title_keys(spark, d):
    raw = by(3, joined("012-27 Clerk ", NUMBER(), "  (Amendment 2) ", F.col("source")), joined("Clerk ", NUMBER(), " (please apply online) ", F.col("source"), " (PeopleAdmin)"), joined(" Clerk  ", NUMBER(), " ", F.upper("source")))
    return docs(spark, d).select("doc_id", T.title_key(raw).alias("title_key"))


@query("first_distinct", "SELECT doc_id, CASE WHEN lower(lang) = 'en' THEN 'News|EN' ELSE 'News|EN|' || lang END || '|' || source AS tags FROM documents")
def first_distinct(spark, d):
    tags = F.array(F.lit("News"), F.lit("EN"), F.col("lang"), F.lit("news"), F.col("source"), F.upper("source"), F.lit("more"))
    return docs(spark, d).select("doc_id", F.array_join(F.filter(T.first_distinct(tags), lambda t: t != "more"), "|").alias("tags"))


@query("strip_html", r"SELECT doc_id, trim(regexp_replace(replace(replace(coalesce(text, ''), '<', ' '), '>', ' ') || ' & end', '[ \n\r\t]+', ' ', 'g')) AS plain FROM documents")
def strip_html(spark, d):
    body = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" ")), F.lit("&"), F.lit("&amp;"))
    raw = joined("<script>var a = '<p>no</p>';</script><style>p {}</style><p>", F.replace(body, F.lit("\n"), F.lit("</p><figure>no<figcaption>no</figcaption></figure><p>")), "</p>&amp; <b>end</b>")
    return docs(spark, d).select("doc_id", T._udf(H.strip_html)(raw).alias("plain"))


_URL = r"""k AS (SELECT page_id, 'https://www.' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || '/' || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'a/' || page_id END AS u FROM pages)"""


def _plain_urls(spark, d):
    p = F.col("page_id")
    return table(spark, d, "pages").select("page_id", joined("https://www.", F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1), "/", F.when(p % 3 == 0, "").otherwise(joined("a/", p.cast("string")))).alias("u"))


@query("url_variants", f"WITH {_URL}, h AS (SELECT page_id, regexp_replace(u, '^https://www[.]', '') AS r FROM k), v AS (SELECT page_id, s || w || CASE WHEN page_id % 3 = 0 THEN r ELSE r || e END AS v FROM h, (VALUES ('http://'), ('https://')) AS a(s), (VALUES (''), ('www.')) AS b(w), (VALUES (''), ('/')) AS c(e)) SELECT page_id, string_agg(DISTINCT v, ' ' ORDER BY v) AS variants FROM v GROUP BY 1")
def url_variants(spark, d):
    return _plain_urls(spark, d).select("page_id", F.array_join(U.variants(F.col("u")), " ").alias("variants"))


@query("url_kinds", r"SELECT page_id, CASE WHEN page_id % 5 < 3 THEN 'a' || page_id || '.example.com' ELSE 'x.org' END AS domain, page_id % 5 <> 4 AS is_safe, page_id % 5 = 2 AS is_pdf, page_id % 5 IN (0, 1) AS is_article FROM pages")
def url_kinds(spark, d):
    p = F.col("page_id")
    host = joined("https://www.a", p.cast("string"), ".example.com")
    u = by(5, joined(host, "/2024/1/x"), joined(host, "/n/a-long-name-of-a-story.html?x=1"), joined(host, "/File.PDF?d=1"), "http://x.org/about", "ftp://x.org/2023/x", key=p)
    return table(spark, d, "pages").select("page_id", U.domain(u).alias("domain"), U.safe_url(u).isNotNull().alias("is_safe"), U.is_pdf(u).alias("is_pdf"), U.looks_like_article(u).alias("is_article"))


@query("url_unwrap", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'https://x.com/r?url=https%3A%2F%2Fa.com%2F1' ELSE 'https://a.com/' || doc_id || '?q=1' END AS url FROM documents")
def url_unwrap(spark, d):
    target = joined("https%3A%2F%2Fa.com%2F", NUMBER(), "%3Fq%3D1")
    u = by(3, joined("https://www.bing.com/news/apiclick.aspx?ref=x&url=", target, "&c=2"), joined("https://news.google.com/r?url=", target), "https://x.com/r?url=https%3A%2F%2Fa.com%2F1")
    return docs(spark, d).select("doc_id", U.unwrap_redirect(u).alias("url"))


@query("usable_pictures", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'https://x.com/photos/' || doc_id || '.jpg' END AS image_url FROM documents")
def usable_pictures(spark, d):
    u = by(4, joined("https://x.com/photos/", NUMBER(), ".jpg"), joined("https://x.com/site-Logo-", NUMBER(), ".png"), "https://x.com/a.svg?x=1", "data:image/png;base64,xyz")
    return docs(spark, d).select("doc_id", U.usable_image(u).alias("image_url"))


_NUMBER_SHAPE = r"CASE WHEN regexp_matches(CAST(doc_id AS VARCHAR), '^(19|20)\d\d$') THEN '{year}' ELSE '{n}' END"


@query("url_shapes", f"SELECT doc_id, '/news/' || {_NUMBER_SHAPE} || ['/{{slug}}.html/', '/short', '/{{date}}/', '/x_{{uuid}}.html', '/v{{id}}-a'][1 + doc_id % 5] AS shape FROM documents")
def url_shapes(spark, d):
    last = by(5, joined("/a-long-name-", NUMBER(), ".html/"), "//short", "/2024-01-02/", "/x_0a1b2c3d-0000-1111-2222-0123456789ab.html", "/v123456-a")
    return docs(spark, d).select("doc_id", U.path_shape(joined("https://a.com/news/", NUMBER(), last, "?x=1")).alias("shape"))


@query("cms_marks", "SELECT doc_id, ['WordPress 6.1, WordPress', 'BLOX/TownNews', 'unknown', 'Drupal, Wix'][1 + doc_id % 4] AS cms FROM documents")
def cms_marks(spark, d):
    page = by(4, '<meta name="generator" content="WordPress 6.1"><img src="/wp-content/a.jpg">', "<div class='tncms-x'>townnews</div>", joined("<p>", NUMBER(), "</p>"), "<script src='https://static.wixstatic.com/x'></script><div data-drupal-x></div>")
    return docs(spark, d).select("doc_id", T._udf(H.cms_of)(page).alias("cms"))


@query("url_excluded", "SELECT doc_id, doc_id % 4 IN (1, 2) AS excluded FROM documents")
def url_excluded(spark, d):
    return docs(spark, d).select("doc_id", U.excluded(by(4, "https://a.com/news/1", "https://a.com/Sports/1", joined("https://a.com/tag/", NUMBER()), "https://a.com/transport/"), ["/sports?/", r"/tag/\d+"]).alias("excluded"))


_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def E():
    return F.col("event_id")


@query("parse_datetime", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 10 HOUR WHEN 2 THEN date_trunc('minute', ts) - INTERVAL 10 HOUR WHEN 3 THEN date_trunc('second', ts) - INTERVAL 10 HOUR END AS at FROM events")
def parse_datetime(spark, d):
    ts = lambda form: F.date_format("ts", form)
    raw = by(5, ts("yyyy-MM-dd'T'HH:mm:ss'Z'"), joined(ts("EEE, dd MMM yyyy HH:mm:ss"), " +1000"), ts("MMMM d, yyyy h:mm a"), ts("yyyy-MM-dd HH:mm:ss"), "1970-01-01T00:00:00Z", key=E())
    return _events(spark, d).select("event_id", D.parse_datetime(raw, FAR).alias("at"))


@query("find_date", "SELECT event_id, CAST(CASE WHEN event_id % 6 < 5 THEN CAST(ts AS DATE) END AS VARCHAR) AS day FROM events")
def find_date(spark, d):
    ts = lambda form: F.date_format("ts", form)
    raw = by(6, joined("Closes ", ts("M/d/yy"), " or 1/1/2029"), joined("by ", ts("MMMM d"), "th, ", ts("yyyy")), joined("at ", ts("yyyy-MM-dd'T'HH:mm")), joined("on ", ts("dd MMM. yyyy"), ", not 2029-01-01"), ts("MM/dd/yyyy"), "13/45/2024 and Janus 3, 2024", key=E())
    return _events(spark, d).select("event_id", D.find_date(raw).cast("string").alias("day"))


@query("closing_notes", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'Open until filled' END AS note FROM events")
def closing_notes(spark, d):
    return _events(spark, d).select("event_id", D.closing_note(by(4, "Open Until Filled", "until the position is filled", "No closing date", joined("closes ", F.date_format("ts", "M/d/yyyy")), key=E())).alias("note"))


_NOW = "TIMESTAMP '2024-02-01 12:00:00'"


@query(
    "time_labels",
    f"""WITH e AS (SELECT event_id, {_NOW} - to_seconds(CAST(event_id * 977 AS BIGINT)) AS t, event_id * 977 AS s FROM events), l AS (SELECT *, t + INTERVAL 10 HOUR AS g, CAST(t + INTERVAL 10 HOUR AS DATE) AS day FROM e)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS BIGINT) || ' min ago' WHEN s < 7200 THEN '1 hr ago' WHEN s < 86400 THEN CAST(s // 3600 AS BIGINT) || ' hrs ago' WHEN day = DATE '2024-01-31' THEN 'yesterday'
WHEN year(day) = 2024 THEN strftime(day, '%b %-d') ELSE strftime(day, '%b %-d, %Y') END AS ago, strftime(g, '%b %-d, %Y, %-I:%M %p ChST') AS at, CASE WHEN day = DATE '2024-02-01' THEN 'Today · ' WHEN day = DATE '2024-01-31' THEN 'Yesterday · ' ELSE '' END || strftime(day, '%A, %B %-d, %Y') AS label, CAST(s AS DOUBLE) AS age FROM l""",
)
def time_labels(spark, d):
    now = dt.datetime(2024, 2, 1, 12, tzinfo=dt.UTC)
    rows = table(spark, d, "events").select("event_id", F.timestamp_seconds(F.lit(1706788800) - E() * 977).alias("t"))
    day = F.to_date(F.from_utc_timestamp("t", D.ZONE))
    return rows.select("event_id", D.relative_time(F.col("t"), now).alias("ago"), D.local_datetime(F.col("t")).alias("at"), D.day_label(day, dt.date(2024, 2, 1)).alias("label"), D.age_seconds(F.col("t"), now).alias("age"))


def P():
    return F.col("p_partkey")


@query("tidy_pay", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$' || format('{:,.2f}', p_retailprice) || ' per month' WHEN 1 THEN '$' || p_size || ' per hour' WHEN 2 THEN 'Depends on skill' ELSE '$' || format('{:,.2f}', p_size * 1000.0) || ' to $' || format('{:,.2f}', p_size * 2000.0) || ' per year' END AS pay FROM part")
def tidy_pay(spark, d):
    size = F.col("p_size")
    raw = by(4, joined(F.format_string("%.2f", "p_retailprice"), " month"), joined("$", size.cast("string"), "/hr"), "DEPENDS ON SKILL year", joined((size * 1000).cast("string"), " to ", F.format_number(size * 2000, 0), " per yr"), key=P())
    return table(spark, d, "part").select("p_partkey", M.tidy_pay(raw).alias("pay"))


@query("find_pay", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '$' || p_size || '.50 an hour' WHEN 1 THEN '$' || p_size || ',000 - $90,000' END AS pay FROM part")
def find_pay(spark, d):
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", M.find_pay(by(3, joined("Full time, $", size, ".50  an hour, or more"), joined("from $", size, ",000 -\n$90,000."), "by agreement", key=P())).alias("pay"))


@query("pay_range", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '$' || format('{:,.2f}', p_retailprice) || ' to $' || format('{:,.2f}', p_retailprice * 2) || ' per hour' WHEN p_size % 3 = 1 THEN '$' || format('{:,.2f}', p_retailprice * 2) || ' per year' END AS pay FROM part")
def pay_range(spark, d):
    s, price = F.col("p_size") % 3, F.col("p_retailprice")
    low, high = F.when(s == 0, price.cast("string")).otherwise("0"), F.when(s < 2, (price * 2).cast("string"))
    return table(spark, d, "part").select("p_partkey", M.pay_range(low, high, F.when(s == 0, "PH").otherwise("PA")).alias("pay"))


@query("excluded_labels", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'POLÍTICA' WHEN lang = 'fr' THEN 'fr' WHEN doc_id % 3 = 1 AND lang = 'en' THEN 'En ' END AS label FROM documents")
def excluded_labels(spark, d):
    labels = F.when(K() % 3 == 0, F.array(F.lit("news"), F.lit("POLÍTICA"), F.col("lang"))).when(K() % 3 == 1, F.array(F.when(F.col("lang") == "en", "En ").otherwise(F.col("lang")))).otherwise(F.array(F.when(F.col("lang") == "en", "x").otherwise(F.col("lang"))))
    wanted = F.when(K() % 2 == 0, F.array(F.lit("politica"), F.lit("FR"), F.lit("en"))).otherwise(F.array(F.lit("Política "), F.lit(" fr"), F.lit("EN")))
    return docs(spark, d).select("doc_id", I.excluded_label(labels, wanted).alias("label"))


@query("picture_rules", "SELECT p_partkey, p_size >= 20 AND p_size <= 30 AND p_partkey % 4 <> 3 AS usable, left(sha1('https://x.com/' || p_partkey), 24) || '.webp' AS name FROM part")
def picture_rules(spark, d):
    size = F.col("p_size")
    usable = I.usable_size(size * 10, F.when(size <= 30, F.lit(120)).otherwise(F.lit(40)), F.when(P() % 4 == 3, "BMP").otherwise("jpeg"))
    return table(spark, d, "part").select("p_partkey", usable.alias("usable"), I.image_name(joined("https://x.com/", P().cast("string"))).alias("name"))


@query("robots_rules", "SELECT doc_id, doc_id % 3 <> 0 AS allowed, CASE WHEN doc_id % 2 = 0 THEN 'https://a.com/s' || doc_id || '.xml' ELSE '' END AS sitemaps FROM documents")
def robots_rules(spark, d):
    from tidewire.sources.pages import sitemaps_in_robots

    robots = joined("User-agent: *\nDisallow: /private\n", by(2, joined("Sitemap: https://a.com/s", NUMBER(), ".xml\n"), "sitemap:\n"))
    url = by(3, joined("https://a.com/private/", NUMBER()), joined("https://a.com/x/", NUMBER()), "https://a.com/")
    return docs(spark, d).select("doc_id", fetching.allowed(robots, url, "reader").alias("allowed"), F.array_join(sitemaps_in_robots(robots), " ").alias("sitemaps"))


@query("fetch_outcomes", "SELECT doc_id, ['ok', 'unchanged', 'throttled', 'gone', 'blocked', 'failed', 'failed'][1 + doc_id % 7] AS outcome, CASE doc_id % 3 WHEN 0 THEN 'Cloudflare' WHEN 1 THEN 'Akamai' END AS service FROM documents")
def fetch_outcomes(spark, d):
    status = F.get(F.array(*map(F.lit, (200, 304, 429, 410, 403, 500, 302))), (K() % 7).cast("int"))
    headers = F.create_map(F.lit("server"), by(3, "cloudflare", "AkamaiGHost", "nginx"))
    body = by(3, "<title>Just a moment...</title>", "<title>Access Denied</title>", "<title>News</title>")
    return docs(spark, d).select("doc_id", fetching.outcome(status).alias("outcome"), I.bot_check(headers, F.lit(403), body).alias("service"))
