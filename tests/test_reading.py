"""What pages and texts say, on cases that are made to mislead."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, html, money, text, urls
from tidewire.operators import jobs
from tidewire.sources import boards, pages

D = dt.date


@pytest.mark.parametrize(
    ("written", "found"),
    [
        ("Closes 1/2/24 or 3/4/2025", D(2024, 1, 2)),
        ("on May 5th, 2026.", D(2026, 5, 5)),
        ("5 Sept. 2026", D(2026, 9, 5)),
        ("sep 7 2026 and 2026-01-01", D(2026, 9, 7)),
        ("2026-02-30, then 2026-03-01", D(2026, 3, 1)),
        ("13/45/2024 and Janus 3, 2024", None),
        ("a2024-05-06", None),
        ("2024-05-067", None),
        ("Maybe 5, 2026", None),
        ("May 5, 20266", None),
        ("1989-12-31 2101-01-01", None),
        ("room 12 march 2026", D(2026, 3, 12)),
        ("1/2/243", None),
        ("2026-05-06T08:00", D(2026, 5, 6)),
        ("march  \n 3 2026", D(2026, 3, 3)),
        ("3/4", None),
        ("", None),
        (None, None),
        ("٣/٤/٢٠٢٦ 1/", None),
    ],
)
def test_first_date(written, found):
    assert dates.first_date(written) == found


@pytest.mark.parametrize(
    ("written", "found"),
    [
        ("Pay: $15.50 - $20/hr, full time", "$15.50 - $20/hr"),
        ("$ 1,200.00  to 1,500 per month", "$ 1,200.00 to 1,500 per month"),
        ("from $45,000 – $50,000 a year", "$45,000 – $50,000 a year"),
        ("$15 an hourly rate", "$15 an hour"),
        ("$15 per visit", "$15"),
        ("$15 to be agreed", "$15"),
        ("US$ and 20 $", None),
        ("20 dollars", None),
        ("$5 per", "$5"),
        ("", None),
        (None, None),
    ],
)
def test_first_pay(written, found):
    assert money.first_pay(written) == found


def test_pictures_that_show_nothing(spark):
    nothing = ["https://e.com/site-logo.png", "https://e.com/x/default_image.jpg", "https://e.com/defaultImage3.jpg", "https://e.com/a.svg?v=1", "https://e.com/ads/x.jpg", "https://e.com/ad/x.jpg", "https://e.com/banner-ad.gif", "https://e.com/blank.gif", "https://secure.gravatar.com/x", "https://e.com/1pixel.gif"]
    shown = ["https://e.com/roads/bridge.jpg", "https://e.com/leaders.jpg", "https://e.com/blanket.jpg", "https://e.com/default.jpg", "https://e.com/photo.jpg?x=a.svg", "https://e.com/banner.jpg"]
    df = spark.createDataFrame([(u,) for u in nothing + shown], "u string")
    assert [r[0] for r in df.select(urls.shows_nothing(F.col("u"))).collect()] == [True] * len(nothing) + [False] * len(shown)


def test_feed_summaries(spark):
    cases = {
        "Officials read more than 200 letters before the vote.": "Officials read more than 200 letters before the vote.",
        "Read more books, says the mayor.": "Read more books, says the mayor.",
        "Continue reading": "Continue reading",
        "A storm. The post A storm over the harbor appeared first on Island News.": "A storm.",
        "The post Ab cd appeared first on News": None,
        "He left the post. The post Office hours appeared first on Island News": "He left the post.",
        "It appeared first on Monday [&#8230;]": "It appeared first on Monday",
        "[...]": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(text.feed_summary(F.col("s"))).collect()] == list(cases.values())


def test_notices_and_credits(spark):
    rest = " and this goes on for long enough to be a paragraph of its own"
    bad = ["Photo courtesy of the harbor office", "Subscribe to our letter today", "Read more: the harbor", "Watch live at eight", "For immediate release: news", "Email: someone", "This story was first told elsewhere", "© 2026 The News"]
    good = ["Photographers came to the harbor", "Read more books, says the mayor", "Watch officials said the storm", "Share prices fell on Monday", "Telephones were down on the island", "Updates came in all night", "Related work was stopped"]
    df = spark.createDataFrame([(b + rest,) for b in bad + good], "t string")
    assert [r[0] for r in df.select(text.good_paragraph(F.col("t"))).collect()] == [False] * len(bad) + [True] * len(good)
    names = spark.createDataFrame([("Ann / Site Admin and Bo; Web-Designer",), ("Ann and Bo",), ("GuamWebz",), ("Andy Brandt | Webmaster, Cy",), (None,)], "a string")
    assert [r[0] for r in names.select(text.without_credits(F.col("a"))).collect()] == ["Ann, Bo", "Ann and Bo", "", "Andy Brandt, Cy", None]


STORY = [
    "The storm passed over the island on Thursday and left the harbor closed for most of the day, officials said.",
    "Nobody was hurt.",
    "Crews worked through the night to clear the roads, and most schools will open again on Monday morning.",
    "“We were lucky this time,” the mayor said at a meeting with the people of the village.",
]


def page(body, menu=40, comments=5):
    entries = "".join(f"<li><a href='/s/{i}'>Section number {i} of the whole site with a long name to read</a></li>" for i in range(menu))
    said = "".join(f"<div class='comment'><p>I was there and saw it all, and it was worse than what this says, believe me. Number {i} of many.</p></div>" for i in range(comments))
    return f"<html><body><div id='top'><ul>{entries}</ul></div><div class='x1'><h1>Storm</h1>{body}</div><div id='comments'>{said}</div><div><p><a href='/a'>More stories of this kind</a> <a href='/b'>and still more of them</a></p></div><div>Copyright of the site, all of it, for ever and ever.</div></body></html>"


def test_density_leaves_menus_and_comments():
    paragraphs = "".join(f"<p>{t}</p>" for t in STORY)
    assert html.dense_text(html.tree(page(paragraphs))) == STORY
    blocks = "".join(f"<div>{t}</div>" for t in (STORY[0], STORY[2], STORY[3]))
    assert html.dense_text(html.tree(page(blocks))) == [STORY[0], STORY[2], STORY[3]]
    linked = paragraphs.replace("Crews worked", "<a href='/c'>Crews</a> worked")
    assert html.dense_text(html.tree(page(linked)))[2].startswith("Crews worked")
    menu = "".join(f"<p><a href='/{i}'>An entry of the menu that has the length of a sentence, number {i}.</a></p>" for i in range(30))
    assert html.dense_text(html.tree(page(paragraphs).replace("<h1>", f"</div><div>{menu}</div><div><h1>"))) == STORY
    assert html.dense_text(html.tree(page("", comments=0))) == [] == html.dense_text(html.tree("")) == html.dense_text(html.tree("<p></p>"))
    assert html.dense_text(html.tree("<p>" + STORY[0])) == [STORY[0]]


def test_page_state_by_path():
    import json

    pad = {"pad": "x" * 600}
    deep = {"props": {"page": {"storyData": {"blocks": [{"content": STORY[0]}, {"content": STORY[2]}], "teaser": {"text": "Too short"}}}, "menu": {"items": [{"content": "Home and news and sports and weather and jobs and more of everything here, every day"}] * 3}}}
    script = lambda value: f"<script>window.__INITIAL_STATE__ = {json.dumps(value)};go()</script>"
    assert html.embedded(html.tree(script(deep | pad))) == [STORY[0], STORY[2]]
    unnamed = {"a": {"q": [STORY[0], STORY[2]]}, "b": {"q": STORY[3] + " And one more of these."}}
    assert html.embedded(html.tree(script(unnamed | pad))) == [STORY[0], STORY[2]]
    assert html.script_value("{'a': 1}") is None and html.script_value(r'{"a": "it\'s \x41 \- \n"}; more') == {"a": "it's A - \n"}
    assert html.script_value("[" * 100_000) is None
    nested = json.loads('{"story":' * 400 + json.dumps({"body": STORY[0]}) + "}" * 400)
    assert [t for _, t in html.leaves(nested)] == [STORY[0]]
    assert html.needs_javascript("<p>You need to enable JavaScript to run this app.</p>") and html.needs_javascript("<p>Please turn on your JavaScript</p>")
    assert not html.needs_javascript("<p>" + "The class teaches JavaScript and more to all who come by. " * 9 + "</p>")


def test_openings_and_notices():
    root = html.tree("<div class=sideNav><h2>A job announcements</h2><a href=/a.pdf>Left out</a></div><h2>Harbor Office Job Announcements</h2><a href=/1.pdf>Clerk</a><a href='https://x.ucarecd.net/z'>Cook</a><a href=/2.pdf>AmeriCorps job application</a><h3>RCUOG Job Announcements</h3><a href=/3.pdf>Diver</a>")
    got = [(r["title"], r["employer"]) for r in boards.READERS["pdf_links"](root, "https://e.com/")]
    assert got == [("Clerk", "Harbor Office"), ("Cook", "Harbor Office"), ("Diver", "")]
    assert boards.announced_by("Job announcements") == "" and boards.announced_by("View all job announcements") == ""


def test_dates_in_running_text_need_their_mark():
    said = lambda t: html.article(f"<body><p>{t}</p></body>")["dates"]
    assert said("The list, published May 1, 2020, was long.") == [] and said("Updated with data posted 5/1/2020 there") == []
    assert said("Posted: May 1, 2020") == ["May 1, 2020"] and said("Date | 08-12-2026 10:30 x") == ["08-12-2026 10:30"]


def test_times_are_labelled_by_the_zone_that_they_name(spark):
    """ChST is ten hours ahead, also when the region had summer time or another offset."""
    at = [dt.datetime(1977, 8, 27, 12), dt.datetime(1890, 1, 1, 12), dt.datetime(2024, 1, 1, 12)]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp")
    assert [r[0] for r in df.select(dates.local_datetime(F.col("t"))).collect()] == ["Aug 27, 1977, 10:00 PM ChST", "Jan 1, 1890, 10:00 PM ChST", "Jan 1, 2024, 10:00 PM ChST"]


def test_a_sentence_that_begins_with_by_is_no_byline(spark):
    rows = ["By annded ofanbleount thtiononou reingnd.", "By Annabella Maria Bellington-Smith Harbourne", "BY ANNABELLA DE LA HARBOURNE-BELLINGTON-SMITH", "By Bartholomew Bellington and the harbour"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(text.good_paragraph(F.col("t"))).collect()] == [True, False, False, True]


def test_numbers_of_postings_have_two_digits_or_more(spark):
    c = "url string, title string, pdf_url string, reference string"
    rows = [("p1", "Clerk", None, "345-12"), ("p2", "Clerk", None, "345-120"), ("p4", "Clerk", None, "345-13"), ("p3", "Clerk", None, "345-13")]
    rows += [("d1", "345-12 Clerk", "d1", None), ("d2", "345-120 Clerk", "d2", None), ("d3", "345-13 Clerk", "d3", None)]
    got = {r["url"]: r["pdf_url"] for r in jobs.paired_with_pdfs(spark.createDataFrame(rows, c)).collect()}
    assert got == {"p1": "d1", "p2": "d2", "p3": "d3", "p4": None}


def test_a_title_may_end_within_a_reference(spark):
    written = ["Fish &amp;&amp", "A &quot;B&quot; \n &amp;c", "", None]
    df = spark.createDataFrame([(i, None if t is None else f"<html><TITLE lang='x'>{t}</title><p>x</p></html>") for i, t in enumerate(written)], "i int, content string")
    got = [(r["title"], r["written_title"]) for r in pages.page_facts(df).orderBy("i").collect()]
    assert got == [("Fish &&", "Fish &amp;&amp"), ('A "B" &c', "A &quot;B&quot; &amp;c"), (None, None), (None, None)]


def test_rows_leave_python_a_few_pages_at_a_time(spark):
    """One batch of a thousand pages comes back in many, and every row with its page."""
    df = spark.range(1000).coalesce(1).selectExpr("id AS n", "concat('<p>', id, '</p>') AS content", "concat('u', id) AS url")

    def f(content):
        return [(content,)] * 2

    out = pages.rows_of(df, f, "c string", ["content"], {"n": "page", "url": "url"})
    assert out.columns == ["page", "url", "c"] and out.count() == 2000
    assert out.where("c <> concat('<p>', page, '</p>') OR url <> concat('u', page)").count() == 0
    assert pages.PAGES_AT_ONCE < 1000
    spread_out = pages.rows_of(df, f, "c string", ["content"], {"n": "page"}).rdd.getNumPartitions()
    assert spread_out >= spark.sparkContext.defaultParallelism


def test_plain_markup_reads_as_by_the_standard_parser():
    """What the parser isn't shown gives the tree that it would; at odd markup it takes over."""
    pieces = ["<p>", "</p>", "<P CLASS='a b'>", "<div id=x>", "<div id='x' id=\"y\">", "<a href='/v?a=1&amp;b=2&copy=3'>", "</a>", "<br/>", "<img src=\"a.jpg\" alt>", "text ", "a & b", "&lt;p&gt;", "&am", "< b", "<!-- c -->", "<!-->", "<!-- a -- b -->", "<!doctype html>"]
    pieces += ["<![CDATA[ x ]]>", "<script>var a='<p>';</script >", "<script>", "<title>a &amp; <b></title>", "<title>", "<li>a<li>b", "<td>a<th>b<tr>", "</p x>", "</>", "<p\n a = 'b'>", "<p a='b'c='d'>", "<p a='>'>", "<p @click='x'>", "<noscript><p>x</noscript>", "<p a='", "<!--", "\x0b", "é"]
    shape = lambda n: (n.tag, n.attrs, [c if isinstance(c, str) else shape(c) for c in n.children])
    chosen = random.Random(7)
    for _ in range(5000):
        markup = "".join(chosen.choices(pieces, k=chosen.randint(1, 10)))
        whole = html._Builder()
        whole.feed(markup)
        whole.close()
        assert shape(html.tree(markup)) == shape(whole.root), markup


def test_plain_markup_is_not_shown_to_the_parser(monkeypatch):
    shown = []
    monkeypatch.setattr(html._Builder, "goahead", lambda self, end: shown.append(self.rawdata))
    root = html.tree("<!doctype html><table class='a b'><tr><td id=\"x\">one<br/>&amp; two</td></tr></table><!-- no -->")
    assert "".join(shown) == "" and [n.text() for n in html.select(root, "table.a td")] == ["one & two"]


def test_parts_of_one_row_group_are_read_by_all_cores(spark, tmp_path):
    """One row group that is read in many partitions has its rows in one of them."""
    from tidewire.plans import QUERIES

    spark.range(2000).coalesce(1).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    cores, old = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.parquet(f"{tmp_path}/part.parquet").rdd.getNumPartitions() >= cores
        busy = pages.dealt(spark.read.parquet(f"{tmp_path}/part.parquet")).groupBy(F.spark_partition_id()).count()
        assert busy.count() >= cores and busy.agg(F.max("count")).first()[0] < 2000 / cores
        assert "RoundRobinPartitioning" in QUERIES["board_table"](spark, str(tmp_path))._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_links_are_read_by_one_worker_a_task(spark):
    page = "<a href='#x'>a</a><a href=' MAILTO:a@b.c'>b</a><a href='/2024/1/x#c'>short</a><a href='HTTPS://Www.E.com:443/2024/1/x?utm_a=1'>The longest of its texts</a><a href='/2024/1/own/'>self</a><a href='http://[x/2024/1/2'>odd</a>"
    df = spark.createDataFrame([("https://www.e.com/2024/1/own", page), (None, page), ("https://www.e.com/", None)], "url string, content string")
    found = pages.parse_listings(df)
    assert [(r["page_url"], r["pos"], r["url"], r["title"]) for r in found.collect()] == [("https://www.e.com/2024/1/own", 2, "https://www.e.com/2024/1/x", "The longest of its texts")]
    for out in (found, pages.link_shapes(df), pages.advertised_feeds(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_dense_stories_have_every_line_that_their_sql_has(spark, tmp_path):
    """Lines that read like a notice, have few letters or runs of blanks."""
    duckdb = pytest.importorskip("duckdb")
    from tidewire.plans import QUERIES, SQL

    words = "the harbour and the islands of it " * 10
    lines = [f"All rights reserved. The {words}end.", f"Share this {words}end.", f"copyright {words}end.", "a, . " * 70 + "b.", "the  harbour   and " * 20 + "end.", f"  By {words}end.", f"The {words}end.", f"The {words}end.\r"]
    df = spark.createDataFrame([(i, f"{t}\nMore.") for i, t in enumerate(lines)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(SQL["dense_stories"]).fetchall()
    got = QUERIES["dense_stories"](spark, str(tmp_path)).select("url", "title", "intro").collect()
    assert len(expected) == 7 and sorted(map(tuple, got)) == sorted(expected)
