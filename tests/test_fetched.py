"""The data sources over a growing fetch log: batches against the parsers, restarts, files out of order."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewire.sources import fetched, pages

NOW = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def feed(*names):
    items = "".join(f"<item><title>{n}</title><link>https://e.com/{n}</link><description>&lt;p&gt;About {n}.&lt;/p&gt;</description><category>c</category></item>" for n in names)
    return f"<rss><channel>{items}</channel></rss>"


def put(folder, name, rows, groups=2):
    folder.mkdir(exist_ok=True)
    table = pa.table({"url": [u for u, _ in rows], "content": pa.array([c for _, c in rows], pa.string()), "status": [200] * len(rows)})
    pq.write_table(table, str(folder / f".{name}"), row_group_size=groups)
    (folder / f".{name}").rename(folder / name)


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    fetched.register(spark)


def test_batches_equal_the_parsers(spark, tmp_path):
    rows = [(f"https://e.com/f{i}", feed(f"a{i}", f"b{i}")) for i in range(5)] + [("https://e.com/x", None), ("https://e.com/y", "<rss"), ("https://e.com/z", "")]
    put(tmp_path / "log", "2026-01-01T00.parquet", rows)
    put(tmp_path / "log", "2026-01-01T01.parquet", [], 1)
    put(tmp_path / "log", "_half.parquet", rows)
    df = spark.read.format("feeds").load(str(tmp_path / "log"))
    assert df.rdd.getNumPartitions() == 4  # a row group each
    plain = spark.createDataFrame(rows, "url string, content string")
    told = lambda d: sorted(map(str, d.collect()))
    assert told(pages.feed_candidates(df, NOW)) == told(pages.parse_feeds(plain, NOW)) and df.count() == 10
    assert spark.read.format("feeds").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="folder is missing"):
        spark.read.format("feeds").load().count()
    maps = [("https://e.com/s", "<urlset><url><loc>https://e.com/1</loc><lastmod>2026-01-01</lastmod></url></urlset>"), ("https://e.com/i", "<sitemapindex><sitemap><loc>https://e.com/s</loc></sitemap></sitemapindex>")]
    put(tmp_path / "maps", "0.parquet", maps)
    found = spark.read.format("sitemaps").load(f"file://{tmp_path}/maps").collect()
    assert sorted(tuple(r) for r in found) == [("https://e.com/i", "sitemap", "https://e.com/s", None), ("https://e.com/s", "url", "https://e.com/1", "2026-01-01")]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    batches = []

    def run(most=2):
        batches.clear()
        stream = spark.readStream.format("feeds").option("files_a_batch", most).load(str(log))

        def keep(rows, number):
            batches.append(sorted(r["title"] for r in rows.collect()))
            rows.write.mode("append").parquet(str(out))

        q = pages.feed_candidates(stream, NOW).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return [b for b in batches if b]

    for k in range(5):
        put(log, f"{k}.parquet", [(f"https://e.com/f{k}", feed(f"s{k}"))])
    assert run() == [["s0", "s1"], ["s2", "s3"], ["s4"]]
    assert run() == []  # begins behind the last offset
    put(log, "5.parquet", [("https://e.com/f5", feed("s5", "t5"))])
    put(log, "6.parquet", [("https://e.com/f6", None)])
    assert run() == [["s5", "t5"]]
    assert sorted(r["title"] for r in spark.read.parquet(str(out)).collect()) == ["s0", "s1", "s2", "s3", "s4", "s5", "t5"]
    put(log, "4b.parquet", [("https://e.com/late", feed("late"))])
    put(log, "7.parquet", [("https://e.com/f7", feed("s7"))])
    with pytest.raises(Exception, match="have come or gone"):
        run()
