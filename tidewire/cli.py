"""Command line: lists and runs registered queries, reads articles, and checks configuration files.

    python -m tidewire.cli queries
    python -m tidewire.cli run archive_days /data/sf0.01
    python -m tidewire.cli extract pages/ out.parquet
    python -m tidewire.cli config sources.yaml categories.yaml [boards.yaml]
    python -m tidewire.cli probe pages/
    python -m tidewire.cli round state/ pages.parquet log.parquet sources.yaml categories.yaml
    python -m tidewire.cli reclassify state/ sources.yaml categories.yaml
    python -m tidewire.cli board job_table jobs/ pages.parquet source_id [--details details.parquet]
    python -m tidewire.cli wanted job_table jobs/ pages.parquet   (the details that are still to be read)
    python -m tidewire.cli sources state/
    python -m tidewire.cli index state/ index/   (brings a search index up to date with the stored stories)
    python -m tidewire.cli search index/ "harbor storm"
"""

from __future__ import annotations

import argparse
import datetime as dt


def read(spark, path: str):
    """Pages (url, content): a Parquet table, or a folder of files whose paths stand for their addresses."""
    from tidewire.sources.pages import read_pages

    return spark.read.parquet(path).select("url", "content") if path.rstrip("/").endswith(".parquet") else read_pages(spark, path)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidewire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    extract = sub.add_parser("extract")
    extract.add_argument("pages")
    extract.add_argument("out")
    config = sub.add_parser("config")
    config.add_argument("files", nargs="+")
    probe = sub.add_parser("probe")
    probe.add_argument("pages")
    round_ = sub.add_parser("round")
    for name in ("state", "pages", "log"):
        round_.add_argument(name)
    round_.add_argument("files", nargs="+")
    again = sub.add_parser("reclassify")
    again.add_argument("state")
    again.add_argument("files", nargs="+")
    board = sub.add_parser("board")
    board.add_argument("kind")
    board.add_argument("state")
    board.add_argument("pages")
    board.add_argument("source", type=int)
    board.add_argument("--details")
    board.add_argument("--part", action="store_true", help="the listing wasn't read to its end: nothing is removed")
    wanted = sub.add_parser("wanted")
    for name in ("kind", "state", "pages"):
        wanted.add_argument(name)
    listed = sub.add_parser("sources")
    listed.add_argument("state")
    index = sub.add_parser("index")
    index.add_argument("state")
    index.add_argument("index")
    found = sub.add_parser("search")
    found.add_argument("index")
    found.add_argument("query")
    a = p.parse_args(argv)
    if a.command == "config":
        from tidewire.config import read as read_config

        c = read_config(*a.files)
        print(f"{len(c.sources)} sources, {len(c.topics)} topics, {len(c.boards)} boards")
        return
    from tidewire.plans import QUERIES

    if a.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return
    from tidewire.session import session
    from tidewire.sources import pages

    spark = session()
    if a.command == "run":
        QUERIES[a.name](spark, a.tables).show(a.rows, truncate=80)
    elif a.command == "extract":
        pages.extract_articles(pages.read_pages(spark, a.pages), dt.datetime.now(dt.UTC)).write.parquet(a.out)
    elif a.command == "round":
        from tidewire.config import read as read_config
        from tidewire.operators.rounds import run_round

        print(run_round(spark, a.state, spark.read.parquet(a.pages), spark.read.parquet(a.log), read_config(*a.files), dt.datetime.now(dt.UTC)))
    elif a.command == "reclassify":
        from tidewire.config import read as read_config
        from tidewire.operators.rounds import reclassify

        print(f"{reclassify(spark, a.state, read_config(*a.files))} stories")
    elif a.command == "board":
        from tidewire.operators.jobs import check_board

        own = read(spark, a.details) if a.details else None
        print(f"{check_board(spark, a.state, a.kind, read(spark, a.pages), a.source, dt.datetime.now(dt.UTC), complete=not a.part, details=own)} postings")
    elif a.command == "wanted":
        from tidewire.operators import jobs
        from tidewire.schemas import SCHEMAS
        from tidewire.sources.boards import parse_board

        stored = jobs.BucketedTable(spark, f"{a.state.rstrip('/')}/jobs", SCHEMAS["jobs"], "url").read()
        for r in jobs.needs_detail(parse_board(read(spark, a.pages), a.kind), stored).select("detail_url").collect():  # at most needs_detail's limit
            print(r["detail_url"])
    elif a.command == "sources":
        from tidewire.operators.listing import source_status
        from tidewire.operators.rounds import stored_tables

        tables = stored_tables(spark, a.state)
        source_status(tables["articles"].read(), tables["sources"].read(), dt.datetime.now(dt.UTC)).show(1000, truncate=False)
    elif a.command == "index":
        from tidewire.operators.rounds import stored_tables
        from tidewire.search import SearchIndex

        print(f"version {SearchIndex(spark, a.index).follow(stored_tables(spark, a.state)['articles'].read())}")
    elif a.command == "search":
        from tidewire.search import SearchIndex
        from tidewire.search.query import parse

        SearchIndex(spark, a.index).topk(parse(a.query), dt.datetime.now(dt.UTC)).show(30, truncate=False)
    else:
        pages.link_shapes(pages.read_pages(spark, a.pages)).show(truncate=80)


if __name__ == "__main__":
    main()
