"""Search over a postings table that is partitioned by term.

A query reads the postings of its own terms only, groups them by story and evaluates the query's tree on
positions; no story is scanned that has none of the terms, unless the query consists of exclusions.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import age_seconds
from tidewire.operators.listing import Filters, Page, by_date, narrowed, paged
from tidewire.search.analysis import each_token, tokens
from tidewire.search.query import Query, parse

MARKS = ("⟦", "⟧")
#: What a term counts by the field it stands in.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: The share of the query's trigrams that a title must have in one stretch.
SIMILAR = 0.6
#: Stories whose postings Python holds at once, and characters of their texts, beside those of one story.
STORIES_AT_ONCE = 200
CHARACTERS_AT_ONCE = 1 << 20


def build_postings(articles: DataFrame, *others: str) -> DataFrame:
    """term, id, positions, weights and other columns as they are: title (A), intro (B), then keywords, section and author (C), positions running on."""
    return told_postings(articles, *others).withColumn("weights", F.split("weights", ""))


def posting_batches(batches: Iterator[pa.RecordBatch], others: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The postings of batches of stories (id, others, _fields): those of STORIES_AT_ONCE stories, or of CHARACTERS_AT_ONCE of text and what its last story has more, in one batch."""
    known: dict[str, str | None] = {}
    for batch in batches:
        stories = batch.column("_fields")
        owner, words, ends, places, marks = [], [], [0], [], []
        held, characters = 0, 0
        for k in range(batch.num_rows):
            found: dict[str, tuple[list[int], list[str]]] = {}
            base = 0
            for weight, text in zip("ABC", stories[k].as_py().values(), strict=True):
                at = 0
                for term, at, *_ in each_token(text, known):  # noqa: B007
                    if term:
                        p, w = found.setdefault(term, ([], []))
                        p.append(base + at)
                        w.append(weight)
                base += at
                characters += len(text or "")
            for term, (p, w) in found.items():
                owner.append(k)
                words.append(term)
                places += p
                ends.append(len(places))
                marks.append("".join(w))
            held += 1
            if held < STORIES_AT_ONCE and characters < CHARACTERS_AT_ONCE and k < batch.num_rows - 1:
                continue
            own = {c: batch.column(c).take(pa.array(owner, pa.int64())) for c in ("id", *others)}
            own |= {"term": pa.array(words, pa.string()), "positions": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32())), "weights": pa.array(marks, pa.string())}
            yield pa.RecordBatch.from_arrays([own[c] for c in ("term", "id", "positions", "weights", *others)], ["term", "id", "positions", "weights", *others])
            owner, words, ends, places, marks = [], [], [0], [], []
            held, characters = 0, 0


def told_postings(articles: DataFrame, *others: str) -> DataFrame:
    """`build_postings` with the weights as one text. Rows leave Python flat, those of a few stories or of a few long texts at a time."""
    kinds = dict(articles.dtypes)
    rows = articles.select("id", *others, F.struct("title", "intro", F.concat_ws(" ", "keywords", "section", "author").alias("rest")).alias("_fields"))
    schema = ", ".join(["term string", f"id {kinds['id']}", "positions array<int>", "weights string", *(f"`{c}` {kinds[c]}" for c in others)])
    return rows.mapInArrow(lambda batches: posting_batches(batches, others), schema)


def write_postings(postings: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Stores postings in buckets of the term, sorted, so that a query opens the buckets of its terms. The stored table."""
    out = postings.repartition(buckets, "term").write.bucketBy(buckets, "term").sortBy("term", "id").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(table)
    return postings.sparkSession.table(table)


def cover_rank(query: Query, positions: dict[str, list[int]], weights: dict[str, list[str]]) -> float:
    """Cover density: over the shortest stretches that hold all terms, the harmonic mean of their weights over the words in between, as r / (r + 1)."""
    wanted = query.positive & set(positions)
    if not wanted:
        return 0.0
    every = sorted((p, t, FIELD_WEIGHTS[w]) for t in wanted for p, w in zip(positions[t], weights[t], strict=True))
    need = len(wanted)
    counts: dict[str, int] = {}
    left, total = 0, 0.0
    for right, (_, term, _) in enumerate(every):
        counts[term] = counts.get(term, 0) + 1
        if len(counts) < need:
            continue
        while counts[every[left][1]] > 1:
            counts[every[left][1]] -= 1
            left += 1
        stretch = every[left : right + 1]
        noise = max(0, stretch[-1][0] - stretch[0][0] - (len(stretch) - 1))
        total += len(stretch) / sum(1 / w for *_, w in stretch) / (1 + noise)
        del counts[every[left][1]]  # the next cover begins behind this one's first term
        left += 1
    return total / (total + 1)


def judged(postings: DataFrame, query: Query) -> DataFrame:
    """id and text rank of the stories with some of the query's terms that match."""
    terms = query.terms

    @F.pandas_udf("struct<ok: boolean, rank: double>")
    def judge(found: pd.Series) -> pd.DataFrame:
        ok, rank = [], []
        for rows in found:
            positions = {r["term"]: list(r["positions"]) for r in rows}
            weights = {r["term"]: list(r["weights"]) for r in rows}
            ok.append(query.matches(positions))
            rank.append(cover_rank(query, positions, weights) if ok[-1] else 0.0)
        return pd.DataFrame({"ok": ok, "rank": rank})

    own = postings.where(F.col("term").isin(terms)).groupBy("id").agg(F.collect_list(F.struct("term", "positions", "weights")).alias("found"))  # at most one row a term
    # only stories that have all terms of an alternative reach Python
    there = F.transform("found", lambda x: x["term"])
    able = F.lit(False)
    for alternative in query.alternatives:
        needed = sorted({t for p in alternative if not p.negated for t in p.terms})
        able = able | (F.size(F.array_except(F.array(*map(F.lit, needed)).cast("array<string>"), there)) == 0)
    if not query.needs_all:
        own = own.where(able)
    told = own.select("id", judge("found").alias("j")).select("id", "j.ok", "j.rank")
    return told if query.needs_all else told.where("ok").drop("ok")


def matched(articles: DataFrame, postings: DataFrame, query: Query) -> DataFrame:
    """id and text rank of the stories that match."""
    told = judged(postings, query)
    if not query.needs_all:
        return told
    return articles.select("id").join(told, "id", "left").where(F.coalesce("ok", F.lit(True))).select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def highlighted(text, query: Query):
    """A column's text with the words that the query asks for between marks."""
    wanted = query.positive

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            for term, _, a, b in reversed(tokens(t)):
                if term in wanted:
                    t = t[:a] + MARKS[0] + t[a:b] + MARKS[1] + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return mark(text)


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether a text has a phrase of ASCII words as it is written, between other characters than letters."""
    return F.lower(text).rlike(rf"(^|[^a-z]){'[^a-z]'.join(map(re.escape, phrase.lower().split()))}([^a-z]|$)")


def decayed(rank: Column, at: Column, now: dt.datetime) -> Column:
    """A rank that falls with age: halved after a year, a third after two."""
    return rank / (1 + age_seconds(at, now) / (86400 * 365.0))


def _plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"))


def term_stats(texts: DataFrame) -> DataFrame:
    """term, docs and n of every word in ASCII letters, of texts (id, text)."""
    per_text = texts.select("id", F.explode(_plain_words(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("k"))
    return per_text.groupBy("term").agg(F.count("*").alias("docs"), F.sum("k").alias("n"))


def trigram_counts(texts: DataFrame) -> DataFrame:
    """g and n: in how many texts (id, text) each trigram of their words in ASCII letters occurs."""
    padded = F.transform(F.array_distinct(_plain_words(F.col("text"))), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))
    return texts.select(F.explode(F.array_distinct(grams)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


def trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def word_similarity(q: str, text: str | None, floor: float = 0.3) -> float:
    """The greatest share of the query's trigrams that a stretch of the text's trigrams holds, less what the stretch has besides.

    A stretch is followed while it can still beat the best one and the floor, so its length is bounded by the query's; below the floor
    the answer is 0.
    """
    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    wanted = {g for w in words(q) for g in trigrams(w)}
    have = [g for w in words(text or "") for g in trigrams(w)]
    best = 0.0
    for a, first in enumerate(have):
        if first not in wanted:
            continue
        shared: set[str] = set()
        noise: set[str] = set()
        for g in have[a:]:
            if g in wanted:
                shared.add(g)
                best = max(best, len(shared) / (len(wanted) + len(noise)))
            else:
                noise.add(g)
                if len(wanted) / (len(wanted) + len(noise)) <= max(best, floor):
                    break
    return best if best >= floor else 0.0


def similar_titles(rows: DataFrame, q: str, limit: int) -> DataFrame:
    """Stories whose title is like q, most similar first. Titles without a trigram of q don't reach Python."""

    @F.pandas_udf("double")
    def score(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: word_similarity(q, t)).astype(float)

    grams = sorted({g.strip() for w in re.findall(r"[^\W_]+", q.lower()) for g in trigrams(w) if len(g.strip()) >= 2})
    some = F.lit(False)
    for g in grams:
        some = some | F.lower("title").contains(g)
    scored = rows.where(some).withColumn("similarity", score("title")).where(F.col("similarity") >= SIMILAR)
    return scored.orderBy(F.desc("similarity"), F.col("published_at").desc_nulls_first(), F.desc("id")).limit(limit)


def search(articles: DataFrame, sources: DataFrame, postings: DataFrame, f: Filters, now: dt.datetime, page: int = 1, per_page: int = 30) -> tuple[Page, bool]:
    """A page of matches and whether they are similar titles instead: these stand in when nothing matches exactly."""
    rows = narrowed(articles, sources, f)
    query = parse(f.q)
    if not query.alternatives:
        return Page(paged(rows, by_date("oldest" if f.sort == "oldest" else "newest"), page, per_page), rows.count(), page, per_page), False
    hits = rows.join(matched(articles, postings, query), "id")
    total = hits.count()
    if total:
        order = by_date(f.sort) if f.sort != "relevance" else [F.desc(decayed(F.col("rank"), F.col("published_at"), now)), F.col("published_at").desc_nulls_first(), F.desc("id")]
        items = paged(hits, order, page, per_page).withColumn("title_marked", highlighted(F.col("title"), query)).withColumn("snippet", highlighted(F.col("intro"), query))
        return Page(items, total, page, per_page), False
    items = similar_titles(rows, f.q, per_page)
    n = items.count()
    return Page(items, n, 1, per_page), n > 0
