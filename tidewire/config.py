"""Configuration from YAML: sources, topics and job boards, validated, as plain objects and as small DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewire.functions.keywords import Topic
from tidewire.functions.text import folded
from tidewire.sources.boards import READERS

SLUG = re.compile(r"^[a-z0-9][a-z0-9-]{0,39}$")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """A site to read. Its fields are those of the configuration file."""

    slug: str
    name: str
    homepage: str | None = None
    enabled: bool = True
    feeds: tuple[str, ...] = ()
    listing_pages: tuple[str, ...] = ()
    sitemaps: tuple[str, ...] = ()
    autodiscover_feeds: bool = False
    article_pattern: tuple[str, ...] = ()
    exclude_url_patterns: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    require_guam: bool = False
    body_selector: str | None = None
    request_delay: float | None = None
    max_age_days: int = 30
    exclude_sections: tuple[str, ...] = ()
    ignore_robots: bool = False
    feed_only: bool = False
    only_in_topic: str | None = None
    undated: bool = False
    cannot_scrape: str | None = None
    reddit: str | None = None

    @property
    def collected(self) -> bool:
        return self.enabled and not self.cannot_scrape


@dataclass(frozen=True)
class Board:
    slug: str
    name: str
    parser: str
    pages: tuple[str, ...] = ()
    homepage: str | None = None
    enabled: bool = True
    employer: str | None = None
    location: str | None = None


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...]
    topics: tuple[Topic, ...]
    places: tuple[str, ...]
    boards: tuple[Board, ...] = ()

    @property
    def hidden(self) -> tuple[str, ...]:
        """Sources shown on their topic's page alone."""
        return tuple(s.slug for s in self.sources if s.only_in_topic)

    def collectable(self, spark: SparkSession) -> DataFrame:
        """slug of the sources that can be collected."""
        return spark.createDataFrame([(s.slug,) for s in self.sources if s.collected], "slug string")

    def left_out(self, spark: SparkSession) -> DataFrame:
        """slug of the sources that a sidebar leaves out: those that can't be collected, and hidden ones."""
        return spark.createDataFrame([(s.slug,) for s in self.sources if s.cannot_scrape or s.only_in_topic], "slug string")

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        """What discovery needs of each source."""
        rows = [(s.slug, s.homepage, s.autodiscover_feeds, list(s.article_pattern), list(s.exclude_url_patterns)) for s in self.sources]
        return spark.createDataFrame(rows, "slug string, homepage string, autodiscover boolean, article_patterns array<string>, exclude array<string>")

    def sources_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s.slug, s.name, s.homepage, s.enabled, list(s.categories), list(s.exclude_sections), s.require_guam, s.feed_only, s.max_age_days, s.undated, bool(s.article_pattern), s.only_in_topic) for s in self.sources]
        return spark.createDataFrame(rows, "slug string, name string, homepage string, enabled boolean, categories array<string>, exclude_sections array<string>, require_place boolean, feed_only boolean, max_age_days int, undated boolean, vouching boolean, only_in_topic string")


def _listed(value) -> tuple[str, ...]:
    return () if value is None else tuple(map(str, value)) if isinstance(value, list) else (str(value),)


def _checked(where: str, patterns: tuple[str, ...]) -> tuple[str, ...]:
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise ConfigError(f"{where}: invalid pattern {p!r}: {e}") from e
    return patterns


def _slugged(raws: list, what: str):
    seen: set[str] = set()
    for raw in raws or []:
        slug = str(raw.get("slug") or "").strip()
        if not SLUG.match(slug):
            raise ConfigError(f"{what}: invalid slug {slug!r}")
        if slug in seen:
            raise ConfigError(f"{what} [{slug}]: duplicate slug")
        seen.add(slug)
        yield slug, raw


def load(sources: dict, categories: dict, boards: dict | None = None) -> Config:
    """The configuration in parsed YAML documents; a mistake raises ConfigError and names the entry."""
    topics = tuple(Topic(slug, str(r.get("name") or slug.title()), _listed(r.get("keywords")), int(r.get("min_score", 3)), bool(r.get("fallback", False)), str(r.get("description") or ""), str(r.get("page_title") or f"{r.get('name') or slug.title()} news")) for slug, r in _slugged((categories or {}).get("categories"), "categories"))
    known = {t.slug for t in topics}
    defaults = (sources or {}).get("defaults") or {}
    out = []
    for slug, r in _slugged((sources or {}).get("sources"), "sources"):
        where = f"sources [{slug}]"
        lifted = {folded(x).strip() for x in _listed(r.get("allow_sections"))}
        patterns = tuple(p for p in _listed(defaults.get("exclude_url_patterns")) if not any(re.search(p, f"/{x}/", re.I) for x in lifted))
        dropped = tuple(x for x in _listed(defaults.get("exclude_sections")) if folded(x).strip() not in lifted)
        subreddit = str(r["reddit"]).strip().removeprefix("r/") if r.get("reddit") else None
        s = Source(
            slug, str(r.get("name") or ""), r.get("homepage"), bool(r.get("enabled", True)), _listed(r.get("feeds")), _listed(r.get("listing_pages")), _listed(r.get("sitemaps")), bool(r.get("autodiscover_feeds", False)), _checked(where, _listed(r.get("article_pattern"))), _checked(where, patterns + _listed(r.get("exclude_url_patterns"))),
            _listed(r.get("categories")), bool(r.get("require_guam", False)), r.get("body_selector"), r.get("request_delay"), int(r.get("max_age_days", defaults.get("max_age_days", 30))), dropped + _listed(r.get("exclude_sections")), bool(r.get("ignore_robots", False)), bool(r.get("feed_only", False)) or bool(subreddit), r.get("only_in_topic"), bool(r.get("undated", False)), str(r["cannot_scrape"]).strip() if r.get("cannot_scrape") else None, subreddit,
        )
        problems = {
            "missing name": not s.name,
            f"unknown categories {sorted(set(s.categories) - known)}": not known.issuperset(s.categories),
            f"unknown only_in_topic {s.only_in_topic!r}": s.only_in_topic and s.only_in_topic not in known,
            "needs at least one feed or listing page": s.collected and not (s.feeds or s.listing_pages or s.reddit),
            "undated needs an article_pattern": s.undated and not s.article_pattern,
            "feed_only needs at least one feed": s.feed_only and not (s.feeds or s.reddit),
            f"invalid subreddit name {subreddit!r}": subreddit and not re.fullmatch(r"\w{2,21}", subreddit),
        }
        for problem, found in problems.items():
            if found:
                raise ConfigError(f"{where}: {problem}")
        out.append(s)
    jobs = []
    for slug, r in _slugged((boards or {}).get("boards") or (boards or {}).get("sources"), "boards"):
        if r.get("parser") not in READERS and r.get("parser") not in ("usajobs", "portal_api"):
            raise ConfigError(f"boards [{slug}]: unknown parser {r.get('parser')!r}")
        jobs.append(Board(slug, str(r.get("name") or slug), r["parser"], _listed(r.get("pages") or r.get("url")), r.get("homepage"), bool(r.get("enabled", True)), r.get("employer"), r.get("location")))
    return Config(tuple(out), topics, _listed((sources or {}).get("guam_keywords")), tuple(jobs))


def read(sources_path: str, categories_path: str, boards_path: str | None = None) -> Config:
    import yaml

    docs = []
    for p in (sources_path, categories_path, boards_path):
        if p is None:
            docs.append(None)
            continue
        with open(p, encoding="utf-8") as f:
            docs.append(yaml.safe_load(f))
    return load(*docs)
