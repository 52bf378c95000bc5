"""Registered queries against the same queries in SQL."""

from __future__ import annotations

import os

import pytest

from tidewire.functions import fetching
from tidewire.operators import listing, outputs
from tidewire.plans import QUERIES, SQL, stand_ins

TABLES = "events documents pages part"
#: Queries whose result may have no rows on small tables.
MAY_BE_EMPTY = ("facet_array", "reused_images")


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(str).replace({"None": "NaN", "nan": "NaN", "NaT": "NaN", "<NA>": "NaN"})
    return sorted(map(tuple, df.values.tolist()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        expected = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected) and (len(got) or name in MAY_BE_EMPTY)


def test_outputs(spark, sf_dir):
    times = listing.sitemap_times(stand_ins.articles(spark, sf_dir), stand_ins.sources(spark, sf_dir))
    assert outputs.sitemap_document(times, "https://e.com/").count("<url>") == times.count()
    assert "status" in outputs.health(stand_ins.sources(spark, sf_dir), stand_ins.NOW).first()["value"]


def test_fetching(spark):
    robots = "User-agent: *\nDisallow: /private\nCrawl-delay: 40"
    df = spark.createDataFrame([(robots, "https://e.com/private/x"), (robots, "https://e.com/a"), (None, "https://e.com/private")], "r string, u string")
    assert [r[0] for r in df.select(fetching.allowed(df.r, df.u, "bot")).collect()] == [False, True, True]
    assert fetching.crawl_delay(robots, "bot") == 15 and fetching.crawl_delay(None, "bot") == 1.5
    assert [fetching.public_address(a) for a in ("8.8.8.8", "10.0.0.1", "127.0.0.1", "::1", "x")] == [True, False, False, False, False]
