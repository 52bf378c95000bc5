"""A search index that is kept up to date: segments of postings, one for each batch of stories, in versions that share them.

A batch adds a segment of its stories' postings, of the trigrams of their titles, and of the ids that it makes out of date in earlier segments.
A posting counts if no later segment has its story's id. `merged` writes what counts into one segment, when there are many.

Postings of a term stand in blocks of like impact: of one month, one greatest weight and one number of occurrences (many are
one class). A small table has each block's size and maxima, from which follows what any story in it can score at most. `topk` ranks the most
promising blocks of each alternative's rarest term first and then only blocks that could still change the page; stories of other
blocks are never ranked, nor are their postings read. That is exact: the bound is never less than a score.

Defined results: a batch without rows gives a version without a new segment; of a story that is twice in a batch the greatest row by
all columns counts; a story without words is found by nothing, yet takes an earlier version of it out; a null id is left out.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.state import upserted
from tidewire.operators.versions import VersionedTable
from tidewire.search.engine import FIELD_WEIGHTS, SIMILAR, decayed, judged, told_postings, trigrams, word_similarity
from tidewire.search.query import Query

STORY = "id long, title string, intro string, keywords string, section string, author string, published_at timestamp"
POSTING = "term string, id long, positions array<int>, weights array<string>, n int, w double, published_at timestamp, block string"
BLOCK = "term string, block string, size long, n int, w double, latest timestamp"
#: Parts of a segment as they are stored: the weights of a posting as one text, and a story's title once, not with each of its trigrams.
PARTS = {"postings": POSTING.replace("array<string>", "string"), "blocks": BLOCK, "grams": "g string, id long", "ids": "id long, told long, title string, published_at timestamp"}
#: Occurrences from which on blocks don't tell numbers apart.
MANY = 8
YEAR = 86400 * 365.0


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def title_grams(text: Column) -> Column:
    """The different trigrams of a title's words."""

    @F.pandas_udf("array<string>")
    def grams(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: sorted({g for w in words(t or "") for g in trigrams(w)}))

    return grams(text)


class SearchIndex(VersionedTable):
    """The index of a folder. Its versions name segments; a version that a stream's batch made is not made twice."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, **lease):
        super().__init__(spark, path, STORY, **lease)
        self.buckets = buckets
        self.ranked = 0  # stories that the last `topk` ranked

    # writing

    def _dealt(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _segment(self, postings: DataFrame, grams: DataFrame, ids: DataFrame) -> str:
        """Writes a segment's parts: postings and trigrams in folders by hash, so that a search opens those of its terms."""
        folder = f"data/{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        # what follows from a posting is added behind the shuffle
        slim = postings.select("term", "id", "positions", "weights", "published_at").repartition(self.buckets, self._dealt("term"), F.date_format("published_at", "yyyyMM"))
        n = F.size("positions")
        weight = functools.reduce(lambda rest, kv: F.when(F.col("weights").contains(kv[0]), kv[1]).otherwise(rest), sorted(FIELD_WEIGHTS.items(), key=lambda kv: kv[1]), F.lit(None).cast("double"))
        block = F.concat_ws(":", F.coalesce(F.date_format("published_at", "yyyyMM"), F.lit("-")), F.col("w").cast("string"), F.least(n, F.lit(MANY)).cast("string"))
        rows = slim.withColumns({"n": n, "w": weight, "bucket": self._dealt("term")}).withColumn("block", block)
        rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/postings")
        told = self.spark.read.schema(PARTS["postings"]).parquet(f"{at}/postings")
        blocks = told.groupBy("term", "block").agg(F.count("*").alias("size"), F.max("n").alias("n"), F.max("w").alias("w"), F.max("published_at").alias("latest"))
        blocks.withColumn("bucket", self._dealt("term")).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{at}/blocks")
        grams.select("g", "id").withColumn("bucket", self._dealt("g")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "g").write.partitionBy("bucket").parquet(f"{at}/grams")
        ids.select("id", "told", "title", "published_at").write.parquet(f"{at}/ids")
        return folder

    def add(self, stories: DataFrame, batch: int | None = None) -> int:
        """A version with these stories, new or changed, as its last segment."""
        before = self._before()
        own = f"data/{uuid.uuid4().hex}"
        columns = [c for c in self.columns if c in stories.columns]
        given = self.spark.createDataFrame([], STORY).unionByName(stories.where("id IS NOT NULL").select(*columns), allowMissingColumns=True)
        upserted(self.spark.createDataFrame([], STORY), given, "id").write.parquet(f"{self.path}/{own}")
        rows = self.spark.read.schema(STORY).parquet(f"{self.path}/{own}")
        try:
            if rows.isEmpty():
                return self._publish(before, before["files"], batch, own) if batch is not None else before["version"]
            postings = told_postings(rows, "published_at")
            grams = rows.select(F.explode(title_grams(F.col("title"))).alias("g"), "id")
            told = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in self.columns))
            folder = self._segment(postings, grams, rows.withColumn("told", told))
            number = max(map(int, before["files"]), default=0) + 1
            return self._publish(before, before["files"] | {f"{number:06d}": [folder]}, batch, folder)
        finally:
            self.folder.remove(own)

    def merged(self) -> int:
        """A version with one segment of all that counts."""
        before = self._before()
        if len(before["files"]) < 2:
            return before["version"]
        parts = [self._live(before, part).drop("segment") for part in ("postings", "grams", "ids")]
        folder = self._segment(*parts)
        return self._publish(before, {max(before["files"]): [folder]}, None, folder)

    def follow(self, stories: DataFrame) -> int:
        """A version with those of all stories that are new or other than the index has them: only these are analysed."""
        now = self.manifest()
        told = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in self.columns))
        last = self._part(now, "ids").groupBy("id").agg(F.max_by("told", "segment").alias("told"))
        given = self.spark.createDataFrame([], STORY).unionByName(stories.select(*(c for c in self.columns if c in stories.columns)), allowMissingColumns=True)
        return self.add(given.withColumn("told", told).join(last, ["id", "told"], "left_anti").drop("told"))

    def fed(self, stream: DataFrame, checkpoint: str, most_segments: int = 12):
        """Starts a query that adds each batch of a stream of stories, once, and merges the segments when they are many."""

        def step(batch: DataFrame, number: int) -> None:
            self._read = None
            last = self.last_batch
            if last is None or number > last:
                self.add(batch, number)
                if len(self.manifest()["files"]) > most_segments:
                    self.merged()

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # reading

    def _part(self, manifest: dict, part: str, keys: list[str] | None = None) -> DataFrame:
        """A part of all segments, with the segment's number; of terms or trigrams only the folders that hold them."""
        key = {"grams": "g"}.get(part, "term")
        wanted = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], f"{key} string").select(self._dealt(key)).distinct().collect()] if keys else []
        out = self.spark.createDataFrame([], f"{PARTS[part]}, segment string")
        for segment in sorted(manifest["files"]):
            at = f"{self.path}/{manifest['files'][segment][0]}/{part}"
            rows = self.spark.read.schema(PARTS[part] + ("" if part == "ids" else ", bucket int")).parquet(at)
            if keys is not None:
                rows = rows.where(F.col("bucket").isin(wanted) & F.col(key).isin(keys))
            out = out.unionByName(rows.drop("bucket").withColumn("segment", F.lit(segment)))
        return out

    def _live(self, manifest: dict, part: str, keys: list[str] | None = None) -> DataFrame:
        """What counts of a part: rows whose story is in no later segment. Of stories that only one segment has nothing meets."""
        rows = self._part(manifest, part, keys)
        if len(manifest["files"]) < 2:
            return rows
        last = self._part(manifest, "ids").groupBy("id").agg(F.max("segment").alias("last"), F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("_id"), "last")
        return rows.join(last, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("last")), "left_anti")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, id, positions, weights and the rest of the postings that count."""
        return self._live(self.manifest(), "postings", terms).drop("segment").withColumn("weights", F.split("weights", ""))

    def matched(self, query: Query) -> DataFrame:
        """id and rank of the stories that match a query none of whose alternatives is exclusions alone."""
        return judged(self.postings(query.terms), query)

    def _bounds(self, blocks: list, query: Query, now: dt.datetime) -> list[tuple[float, str, str, int]]:
        """(what a story can score at most, term, block, rows) of the blocks of each alternative's rarest term, from the greatest."""
        size: dict[str, int] = {}
        most: dict[str, tuple[int, float]] = {}
        for b in blocks:
            size[b["term"]] = size.get(b["term"], 0) + b["size"]
            n, w = most.get(b["term"], (0, 0.0))
            most[b["term"]] = max(n, b["n"]), max(w, b["w"])
        rarest = set()
        for alternative in query.alternatives:
            terms = {t for p in alternative if not p.negated for t in p.terms}
            if terms <= set(size):
                rarest.add(min(terms, key=lambda t: (size[t], t)))
        out: dict[tuple[str, str], list] = {}
        for b in blocks:
            if b["term"] not in rarest:
                continue
            others = [most[t] for t in query.positive if t != b["term"] and t in most]
            # no more covers than occurrences, each at most as heavy as its heaviest word
            covers = (b["n"] + sum(n for n, _ in others)) * max([b["w"], *(w for _, w in others)])
            age = (now - b["latest"].replace(tzinfo=dt.UTC)).total_seconds() if b["latest"] else None
            fade = None if age is None else 1 + age / YEAR
            bound = -1.0 if fade is None else math.inf if fade <= 0 else covers / (covers + 1) / fade
            held = out.setdefault((b["term"], b["block"]), [bound, 0])
            held[0], held[1] = max(held[0], bound), held[1] + b["size"]
        return sorted(((bound, t, block, n) for (t, block), (bound, n) in out.items()), reverse=True)

    def topk(self, query: Query, now: dt.datetime, k: int = 30) -> DataFrame:
        """id, rank, score and published_at of the k best matches: newer before older at equal scores, then the greater id.

        The blocks' table of the query's terms comes to the driver: a term has at most as many blocks as months times classes of weight and number.
        """
        if query.needs_all:
            raise ValueError("a query of exclusions alone has no ranking")
        manifest = self.manifest()
        blocks = self._part(manifest, "blocks", query.terms).collect() if query.terms else []
        bounds = self._bounds(blocks, query, now)
        postings = self._live(manifest, "postings", query.terms).drop("segment").withColumn("weights", F.split("weights", ""))

        def ranked(part: list[tuple[float, str, str, int]]) -> DataFrame:
            mine = F.lit(False)
            for term in sorted({t for _, t, _, _ in part}):
                mine = mine | (F.col("term") == term) & F.col("block").isin([b for _, t, b, _ in part if t == term])
            some = postings.where(mine).select("id", "published_at").distinct()
            told = judged(postings.join(some.select("id"), "id", "left_semi"), query)
            return some.join(told, "id").withColumn("score", decayed(F.col("rank"), F.col("published_at"), now)).select("id", "rank", "score", "published_at")

        order = [F.desc("score"), F.col("published_at").desc_nulls_first(), F.desc("id")]
        first, rows, taken = [], 0, 0
        while taken < len(bounds) and rows < 4 * k:
            first.append(bounds[taken])
            rows, taken = rows + bounds[taken][3], taken + 1
        best = ranked(first).orderBy(*order).limit(k).collect()  # k rows
        least = best[-1]["score"] if len(best) == k and best[-1]["score"] is not None else -math.inf
        more = [b for b in bounds[taken:] if b[0] >= least * (1 - 1e-9)]
        self.ranked = rows + sum(b[3] for b in more)
        return ranked(first + more).orderBy(*order).limit(k)

    def similar(self, q: str, limit: int = 30) -> DataFrame:
        """id, title, published_at and similarity of the titles most like q: first those that have enough of its trigrams, by the stored ones, then the exact score."""
        asked = sorted({g for w in words(q) for g in trigrams(w)})
        empty = "id long, title string, published_at timestamp, similarity double"
        if not asked:
            return self.spark.createDataFrame([], empty)
        enough = math.ceil(SIMILAR * len(asked) - 1e-9)
        manifest = self.manifest()
        held = self._live(manifest, "grams", asked).groupBy("id").agg(F.count("*").alias("shared")).where(F.col("shared") >= enough)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for titles in batches:
                yield titles.map(lambda t: word_similarity(q, t)).astype(float)

        scored = held.join(self._live(manifest, "ids"), "id").select("id", "title", "published_at", score("title").alias("similarity"))
        return scored.where(F.col("similarity") >= SIMILAR).orderBy(F.desc("similarity"), F.col("published_at").desc_nulls_first(), F.desc("id")).limit(limit)
