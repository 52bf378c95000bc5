"""Scalar functions against hand-made cases."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, html, keywords, money, text, urls
from tidewire.operators import ingest
from tidewire.search.analysis import stem, terms
from tidewire.search.engine import cover_rank, word_similarity
from tidewire.search.query import parse

NOW = dt.datetime(2026, 10, 30, tzinfo=dt.UTC)


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("o")).collect()]


@pytest.mark.parametrize(
    ("url", "base", "expected"),
    [
        ("HTTP://WWW.Example.com:80/a//b/?b=2&utm_source=x&a=1#top", None, "http://www.example.com/a/b/?a=1&b=2"),
        ("https://example.com/story/amp/", None, "https://example.com/story/"),
        ("https://example.com/story/amp", None, "https://example.com/story"),
        ("/news/1?fbclid=9&q=", "https://example.com/x", "https://example.com/news/1?q="),
        ("mailto:me@example.com", None, None),
        ("https://localhost/x", None, None),
        ("https://example.com:99999/x", None, None),
        ("https://example.com:8443", None, "https://example.com:8443/"),
    ],
)
def test_normalized(url, base, expected):
    assert urls.normalized(url, base) == expected
    if expected:
        assert urls.normalized(expected) == expected


def test_url_columns(spark):
    v = ["https://www.a.example.com/x/?q=1", "http://b.org"]
    assert column(spark, v, urls.match_key) == ["a.example.com/x?q=1", "b.org"]
    assert column(spark, v, urls.site_of) == ["example.com", "b.org"]
    assert len(column(spark, ["https://a.com/x"], urls.variants)[0]) == 8
    assert len(column(spark, ["https://a.com/"], urls.variants)[0]) == 4
    assert column(spark, ["https://www.bing.com/news/apiclick?url=https%3a%2f%2fx.com%2fy&c=1", "https://x.com/?url=https://z.com"], urls.unwrap_redirect) == ["https://x.com/y", "https://x.com/?url=https://z.com"]
    good = ["https://a.com/2026/09/21/x", "https://a.com/news/one-two-three-four-five", "https://a.com/about", "https://a.com/", "https://a.com/2026/9?x=1", "https://a.com/one-two-three-four.html", "https://a.com/1926/x/09"]
    assert column(spark, good, urls.looks_like_article) == [True, True, False, False, True, False, False]
    links = [("#top", None), ("/a b?q=1#c", "https://x.org/a%20b?q=1"), ("mailto:a@b.c", None), ("javascript:x()", None), ("", None), ("https://y.org/é", "https://y.org/é")]
    assert [urls.absolute_link(h, "https://x.org/j") for h, _ in links] == [u for _, u in links]
    odd = ["https://a.com/x//y", "https://a.com/x/amp", "https://A.com/x", "https://a.com", "https://a.com/x%20y/", "https://a/x", "ftp://a.com/", None, "https://a.com/x?utm_source=1"]
    assert column(spark, odd, urls.normalize_url) == [urls.normalized(u) for u in odd]


def test_text(spark):
    assert text.clean("a&amp;b​  c\\, d") == "a&b c, d"
    assert column(spark, ["a&amp;b​  c\\, d", None], text.clean_text) == ["a&b c, d", ""]
    assert text.folded("Málaga ø") == "malaga ø"
    assert text.unaccented("Málaga ø ß") == "Malaga o ss"
    cases = ["short", "One sentence that is long enough. Then more words follow here", "word " * 20, "x" * 60, "One. Then many more words follow, and so on and on", None]
    assert column(spark, cases, lambda c: text.truncate(c, 40)) == ["short", "One sentence that is long enough.", "word word word word word word word word…", "x" * 40 + "…", "One. Then many more words follow, and…", None]
    outlet = F.lit("Harbor Herald")
    names = ["Ana Reyes Harbor Herald", "The Harbor Herald", "Ana Reyes of the Harbor Herald", "Ana Reyes | Site Admin", "Ana Reyes, harbor herald", "harbor herald", "Newharbor Herald", "Ana Reyes", "", None]
    assert column(spark, names, lambda c: text.clean_byline(c, outlet, F.lit("Herald"), F.lit(None).cast("string"))) == ["Ana Reyes", None, "Ana Reyes", "Ana Reyes", "Ana Reyes", None, "Newharbor", "Ana Reyes", None, None]
    titles = ["Rain stops - Bay Post - Bay Post", "Bay Post", "Rain &amp; wind | bay post", "Rain - Bay Posts", None, "A - Bay Post at noon"]
    assert column(spark, titles, lambda c: text.headline(c, F.lit("Bay Post"))) == ["Rain stops", "Bay Post", "Rain & wind", "Rain - Bay Posts", None, "A - Bay Post at noon"]
    assert column(spark, ["A (b) +c | Q.E (x)"], lambda c: text.headline(c, F.lit("Q.E (x)"))) == ["A (b) +c"]
    assert column(spark, ["  012-34 Cook II (Amendment 2)  now", "Cook II now", "2012-34 Cook", None], text.title_key) == ["cook ii now", "cook ii now", "2012-34 cook", ""]
    labels = spark.createDataFrame([(["News", "Deportes é"], ["DEPORTES É"]), (["a", None, "B "], ["b"]), (["x"], [])], "l array<string>, u array<string>")
    assert [r[0] for r in labels.select(ingest.excluded_label(F.col("l"), F.col("u"))).collect()] == ["Deportes é", "B ", None]
    junk = ["Photo courtesy of the harbour office, which took it on Monday morning", "By Ana Maria Reyes-Smith of Harbour", "News | Sports | Weather and a few more words to make it long enough", "The harbour reopened on Monday, officials said, after two days of wind.", "1234 5678 9012 3456 7890 1234 5678 9012 3456 7890"]
    assert column(spark, junk, text.good_paragraph) == [False, False, False, True, False]
    assert column(spark, ["100%_\\"], text.like_escape) == ["100\\%\\_\\\\"]
    tags = spark.createDataFrame([(["A", "b", "a", "B", "c"],)], "t array<string>")
    assert tags.select(text.first_distinct(F.col("t"), 2)).first()[0] == ["A", "b"]


def test_dates(spark):
    found = column(spark, ["Closes 10/30/2026", "by October 3rd, 2026", "2026-08-26T00:00", "3 Nov 2026 or 1/2/27", "13/45/2026", None], dates.find_date)
    assert found == [dt.date(2026, 10, 30), dt.date(2026, 10, 3), dt.date(2026, 8, 26), dt.date(2026, 11, 3), None, None]
    notes = ["Open until filled", "soon", "until the positions are filled", "Until job is filled.", "No closing date", "CONTINUOUS", "discontinuous", "filled until"]
    assert [n is not None for n in column(spark, notes, dates.closing_note)] == [True, False, True, True, True, True, False, False]
    assert column(spark, ["due Sept. 4, 2026", "12 March 2026", "Marching 3, 2026", "may 5 2026"], dates.find_date) == [dt.date(2026, 9, 4), dt.date(2026, 3, 12), None, dt.date(2026, 5, 5)]
    assert dates.parsed("Sep 21, 2026 8:00 AM", NOW) == dt.datetime(2026, 9, 20, 22, tzinfo=dt.UTC)
    assert dates.parsed("2026-09-21T08:00:00+10:00", NOW) == dt.datetime(2026, 9, 20, 22, tzinfo=dt.UTC)
    assert dates.parsed("1970-01-01", NOW) is None and dates.parsed("2027-01-01", NOW) is None and dates.parsed("soon", NOW) is None
    values = ["2026-09-21T08:00:00+10:00", "Sep 21, 2026 8:00 AM", "1970-01-01T00:00:00Z", "nonsense", None]
    expected = [dt.datetime(2026, 9, 20, 22), dt.datetime(2026, 9, 20, 22), None, None, None]
    assert column(spark, values, lambda c: dates.parse_datetime(c, NOW).cast("string")) == [e and str(e) for e in expected]
    assert dates.retry_after("120", NOW) == 120 and dates.retry_after("Fri, 30 Oct 2026 00:01:00 GMT", NOW) == 60 and dates.retry_after("x", NOW) is None


def test_next_wake():
    at = dt.datetime(2026, 1, 1, 10, 20, tzinfo=dt.UTC)
    assert dates.next_wake(at, 60) == dt.datetime(2026, 1, 1, 11, tzinfo=dt.UTC)
    assert dates.next_wake(at, 60, catch_up=60) == dt.datetime(2026, 1, 1, 10, 21, tzinfo=dt.UTC)
    assert dates.next_wake(at, 60, catch_up=60, wait=5000) == dt.datetime(2026, 1, 1, 10, 30, tzinfo=dt.UTC)
    assert dates.next_wake(at.replace(minute=59, second=30), 60, catch_up=20) == dt.datetime(2026, 1, 1, 11, tzinfo=dt.UTC)


def test_money(spark):
    written = ["3100.5 month", "DEPENDS ON SKILL hour", "$18/hr", "18-21 per hr", "$9 an hour", "1,250 to 1900 yr", "hour", "Open", "$20.00", " ", None, "12 hours"]
    assert column(spark, written, money.tidy_pay) == ["$3,100.50 per month", "Depends on skill", "$18 per hour", "$18.00-$21.00 per hour", "$9 per hour", "$1,250.00 to $1,900.00 per year", "hour", "Open", "$20.00", None, None, "$12.00 hours"]
    assert column(spark, ["pays $15.00 per hour now", "from $45,000 - $60,000", "none"], money.find_pay) == ["$15.00 per hour", "$45,000 - $60,000", None]
    row = spark.createDataFrame([("1000", "2000.5", "PA"), ("0", None, "PA")], "a string, b string, c string")
    assert [r[0] for r in row.select(money.pay_range(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["$1,000.00 to $2,000.50 per year", None]


def test_keywords(spark):
    assert keywords.pattern("employ*") == r"\bemploy\w*"
    topics = [keywords.Topic("military", "Military", ("navy", "service member*")), keywords.Topic("business", "Business", ("bank*",), min_score=1), keywords.Topic("local", "Local", ("police",), fallback=True), keywords.Topic("community", "Community")]
    rows = [("Navy ship arrives", None, None, "https://x.com/a"), ("A day", "service-members and banks", None, "https://x.com/a"), ("A day", "quiet", None, "https://x.com/business/a"), ("A day", None, None, "https://x.com/a"), ("navylike", None, "community", "https://x.com/a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, intro string, section string, url string")
    c = F.col
    got = [r[0] for r in df.orderBy("i").select(keywords.classify(topics, c("title"), c("intro"), c("section"), F.lit(None).cast("string"), c("url"))).collect()]
    assert got == [["military"], ["business"], ["business"], ["local"], ["local"]]
    forced = df.select(keywords.classify(topics, c("title"), c("intro"), c("section"), F.lit(None).cast("string"), c("url"), F.array(F.lit("community")), F.when(c("i") == 4, "military"))).collect()
    assert forced[0][0] == ["military", "community"] and forced[4][0] == ["military"]


def test_html():
    page = """<html><head><title>T - Site</title><meta property="og:title" content="Head &amp; line"><link rel=canonical href="/c">
    <script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","author":{"name":"A B"},"datePublished":"2026-01-02","image":["x.jpg"]}]}</script></head>
    <body><nav><p>menu</p></nav><article><p>First paragraph with unclosed tag<p>Second one <b>bold</b><img src=small.jpg width=10><img data-src=big.jpg></article></body>"""
    a = html.article(page)
    assert a["titles"][0] == "Head & line" and a["canonical"] == ["/c"] and a["author"] == "A B" and a["dates"] == ["2026-01-02"] and a["is_object"]
    assert a["images"] == ["x.jpg"]  # the container is too short to be one
    filled = html.article(page.replace("Second one", "Second one, which goes on for long enough to be taken as a story by its length, that is for more than a hundred and fifty characters of text"))
    assert filled["images"] == ["x.jpg", "big.jpg"] and len(filled["stories"][0]) == 2
    state = json.dumps({"menu": {"text": "Home and news and sports and weather and jobs and more of everything here, every single day"}, "articleData": {"body": "<p>The story stands in the page's state.</p><p>Second \\! part</p>"}, "pad": "x" * 500})
    for script in (f"<script>window.__PAGE_MODEL__ = {state};</script>", f'<script id="__NEXT_DATA__" type="application/json">{state}</script>', "<script>__NUXT__=" + state.replace("part", "p\\'art") + "</script>"):
        assert html.embedded(html.tree(script))[0] == "The story stands in the page's state."
    assert html.embedded(html.tree("<script>var __NUXT__x = 1</script>")) == [] == html.embedded(html.tree(f"<script>window.__PAGE_MODEL__ = function() {state}</script>"))
    assert html.strip_html("<p>a</p><script>x</script> b &amp; c") == "a b & c"
    assert html.widest("a.jpg 300w, b.jpg 800w") == "b.jpg"
    assert [n.attrs["id"] for n in html.select(html.tree('<div class="a b" id=1><p id=2></p></div><p id=3></p>'), "div.a p")] == ["2"]


def test_stemming():
    pairs = {"running": "run", "flies": "fli", "happily": "happili", "nationally": "nation", "relational": "relat", "generously": "generous", "hopping": "hop", "hoping": "hope", "agreed": "agre", "wages": "wage", "shortage": "shortag", "workers": "worker", "typhoon": "typhoon", "skies": "sky", "possibly": "possibl", "cries": "cri", "ties": "tie"}
    assert {w: stem(w) for w in pairs} == pairs
    assert terms("The Ferries of Málaga") == ["ferri", "malaga"]


def test_query_grammar():
    q = parse('"ferry timetable" -monsoon')
    assert q.matches({"ferri": [3], "timet": [4]}) and not q.matches({"ferri": [3], "timet": [5]}) and not q.matches({"ferri": [1], "timet": [2], "monsoon": [9]})
    assert parse("a or wage").terms == ["wage"] and parse("-storm").needs_all and not parse("the of").alternatives
    near, far = {"a1": [1], "b1": [2]}, {"a1": [1], "b1": [9]}
    w = {"a1": ["A"], "b1": ["A"]}
    assert cover_rank(parse("a1 b1"), near, w) > cover_rank(parse("a1 b1"), far, w) > 0
    assert word_similarity("marcon", "Lighthouse Marconi opens") >= 0.6 > word_similarity("zebra", "Lighthouse Marconi opens")


def test_contains_plain_against_unaccented_texts(spark):
    """The collated comparison against removing accents in Python, and no Python in its plan."""
    texts = ["Résumé CAFÉ", "straße", "Ærø", "łódź Đà þing ıs", "O'Brien 100% a_b", "naïve", "ﬁne", "Hafa Adai Guåhan", "x", "", None, "ΣΊΣΥΦΟΣ", "ñ", "œuvre", "ð Ħ", "été"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for q in ("resume", "CAFE", "strasse", "aero", "lodz", "da", "thing", "is", "100%", "a_b", "naive", "fine", "guahan", "x", "", "σισυφος", "n", "oeuvre", "é", "ete", "ss"):
        found = df.select("t", text.contains_plain(F.col("t"), q).alias("a"))
        assert [r["a"] for r in found.collect()] == [None if t is None else text.unaccented(q).lower().replace("ς", "σ") in text.unaccented(t).lower().replace("ς", "σ") for t in texts], q
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
