"""Exact ranked search over dual-sorted wavelet trees, one per shard of documents.

A shard is a block of documents of one input partition, bounded by its postings; nothing is shuffled to make it.
Its documents are numbered by doc_id. Its postings stand term by term, each term's by falling impact, and the
sequence of their document numbers is kept as a wavelet tree, level by level: bit after bit of the number, every
level in the stable order of the bits before it. So one sequence is sorted both ways: a term's range, followed down to a node,
holds its postings within that node's span of documents, still by falling impact, and the first of them bounds them all.

A query starts with the ranges of its terms at the root. The nodes with the greatest bounds, the sum over terms of
weight times the first impact, are opened next, all terms at once, which intersects the terms' ranges with both
halves of the span; a range that gets empty is gone. At a leaf the bound is the document's score. Nodes below the k-th
best score so far are never opened; the k best go from shard to shard within a task, and the tasks' best are ranked in Spark.

Impact is ((10**9 * tf) div (1000 * tf + 8 * m)) with m from the document's length and the corpus' mean, so it needs two
numbers of the whole corpus, which a first scan counts in the JVM. Document frequencies come from the shards' dictionaries.

Defined results: a null or empty text has no terms and is never found; terms and lengths are of whole texts; rows equal in
doc_id are documents of their own; equal scores go by doc_id, a null doc_id last; an item's rows are one item with the
terms of all of them, and a null item_id is an item like any other; an item without terms, or of which no document
scores above 0, has no rows; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.common import forget, lower_ascii, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Postings of a shard; one document with more is a shard of its own.
SHARD_POSTINGS = 1 << 20
#: (item, term) pairs that are searched at a time: a bound on what is sent to the tasks, whatever the number of items.
BLOCK_TERMS = 200_000
#: Nodes opened at a time, from those with the greatest bounds.
OPENED = 128
#: Bytes to bytes: A-Z in lower case, every other byte that is no part of a term a blank.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "doc_ids array<{id}>, n_docs long, n_terms long, terms binary, starts binary, impacts binary, bits binary"


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and their terms with repeats."""

    documents: int
    terms: int


def corpus(docs: DataFrame) -> Corpus:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    return Corpus(row["d"], row["t"])


def _levels(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def tree(numbers: np.ndarray, levels: int) -> bytes:
    """The bits of every level, packed: level by level, each in the stable order of the bits before."""
    out = []
    for shift in range(levels - 1, -1, -1):
        bits = (numbers >> shift) & 1
        out.append(np.packbits(bits.astype(np.uint8)).tobytes())
        numbers = np.concatenate([numbers[bits == 0], numbers[bits == 1]])
    return b"".join(out)


def _shard(rows: list[tuple[object, int, Counter]], size: Corpus) -> list:
    """One row of the index of (doc_id, terms with repeats, frequencies)."""
    rows.sort(key=lambda r: (r[0] is None, 0 if r[0] is None else r[0]))
    terms = sorted(set().union(*(r[2] for r in rows)))
    at = {t: i for i, t in enumerate(terms)}
    number = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    term = np.fromiter((at[t] for r in rows for t in r[2]), np.int64, len(number))
    tf = np.fromiter((n for r in rows for n in r[2].values()), np.int64, len(number))
    m = np.array([10 + 90 * r[1] * size.documents // size.terms for r in rows], np.int64)
    impact = 10**9 * tf // (1000 * tf + 8 * m[number])
    order = np.argsort((term << 20) - impact, kind="stable")  # an impact is less than 2**20; equal ones stay in order of documents
    starts = np.searchsorted(term[order], np.arange(len(terms) + 1)).astype("<i4")
    return [[r[0] for r in rows], len(rows), sum(r[1] for r in rows), b" ".join(terms), starts.tobytes(), impact[order].astype("<i4").tobytes(), tree(number[order], _levels(len(rows)))]


def index(docs: DataFrame, size: Corpus | None = None, postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row for each shard: its documents by doc_id, dictionary, where each term's postings start, impacts, and the wavelet tree's bits. Stored."""
    size = size or corpus(docs)
    schema = INDEX.format(id=docs.schema["doc_id"].dataType.simpleString())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(rows):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_shard(rows, size), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

        rows, held, kinds = [], 0, None
        for batch in batches:
            kinds = kinds or [pa.list_(batch.schema.field(0).type), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = (text or "").encode().translate(FOLDED).split()
                    if not found:
                        continue
                    counts = Counter(found)
                    if rows and held + len(counts) > postings:
                        yield row(rows)
                        rows, held = [], 0
                    rows.append((doc_id, len(found), counts))
                    held += len(counts)
        if rows:
            yield row(rows)

    return stored(docs.select("doc_id", "text").mapInArrow(build, schema), "wavelets", rows_checked=1)


class Shard:
    """A row of the index, ready to be searched: ones before each position, and impacts, of all levels."""

    def __init__(self, doc_ids, terms: bytes, starts: bytes, impacts: bytes, bits: bytes):
        self.doc_ids, self.levels = doc_ids, _levels(len(doc_ids))
        self.term = {t: i for i, t in enumerate(terms.split(b" "))}
        self.starts, now = np.frombuffer(starts, "<i4"), np.frombuffer(impacts, "<i4")
        n = self.n = len(now)
        packed = np.frombuffer(bits, np.uint8).reshape(self.levels, -1)
        self.ones, self.impacts = np.zeros((self.levels, n + 1), np.int32), np.empty((self.levels + 1, n), np.int32)
        self.impacts[0] = now
        for k in range(self.levels):
            one = np.unpackbits(packed[k], count=n)
            np.cumsum(one, out=self.ones[k, 1:])
            self.impacts[k + 1] = now = np.concatenate([now[one == 0], now[one == 1]])
        self.zeros = n - self.ones[:, n].astype(np.int64)
        self.ones, self.impacts = self.ones.reshape(-1), self.impacts.reshape(-1)

    def best(self, terms: list[bytes], weights: list[int], best: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
        """(score, doc_id) of the k best of this shard and of `best`, in order."""
        held = [(self.term[t], w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in self.term]
        if not held:
            return best
        ids, w = np.array(held, np.int64).T
        least = best[-1][0] if len(best) == k else 1
        # the open nodes, and their terms' ranges; ranges of a node are next to each other
        level, span, first = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([0, len(ids)])
        lo, hi = self.starts[ids].astype(np.int64), self.starts[ids + 1].astype(np.int64)
        bound = np.array([(w * self.impacts[lo]).sum()])
        while len(bound):
            keep = bound >= least
            take = np.flatnonzero(keep)
            if len(take) > OPENED:
                take = take[np.argpartition(-bound[take], OPENED - 1)[:OPENED]]
            rest = keep.copy()
            rest[take] = False
            many = first[1:] - first[:-1]
            wait, opened = np.repeat(rest, many), np.repeat(keep & ~rest, many)
            node = np.repeat(np.arange(len(level)), many)[opened]  # of the opened nodes' ranges, node by node
            lv, a, b = level[node], lo[opened], hi[opened]
            base, zero = lv * (self.n + 1), self.zeros[lv]
            one_a, one_b = self.ones[base + a], self.ones[base + b]
            key = np.concatenate([2 * node, 2 * node + 1])
            child_lo, child_hi = np.concatenate([a - one_a, zero + one_a]), np.concatenate([b - one_b, zero + one_b])
            some = np.flatnonzero(child_hi > child_lo)
            some = some[np.argsort(key[some], kind="stable")]
            key, child_lo, child_hi = key[some], child_lo[some], child_hi[some]
            child_w = np.concatenate([w[opened]] * 2)[some]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            sizes, parent = np.diff(starts, append=len(key)), key[starts] // 2
            child_level, child_span = level[parent] + 1, 2 * span[parent] + key[starts] % 2
            child_bound = np.add.reduceat(child_w * self.impacts[np.repeat(child_level, sizes) * self.n + child_lo], starts) if len(key) else key
            leaf = (child_level == self.levels) & (child_bound >= least)
            if leaf.any():
                best = best + [(s, self.doc_ids[d]) for s, d in zip(child_bound[leaf].tolist(), child_span[leaf].tolist(), strict=True)]
                best = sorted(best, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k]
                least = best[-1][0] if len(best) == k else 1
            inner = (child_level < self.levels) & (child_bound >= least)
            mine = np.repeat(inner, sizes)
            first = np.concatenate([[0], np.cumsum(np.concatenate([many[rest], sizes[inner]]))])
            lo, hi, w = np.concatenate([lo[wait], child_lo[mine]]), np.concatenate([hi[wait], child_hi[mine]]), np.concatenate([w[wait], child_w[mine]])
            level, span, bound = np.concatenate([level[rest], child_level[inner]]), np.concatenate([span[rest], child_span[inner]]), np.concatenate([bound[rest], child_bound[inner]])
        return best


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their terms, BLOCK_TERMS pairs at a time at most, but for an item that has more by itself."""
    found = items.select("item_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    found = stored(found.withColumn("_h", F.pmod(F.xxhash64(F.lit("block"), "item_id"), F.lit(1 << 20))), "items")
    per = found.groupBy("_h").agg(F.count("*").alias("n"))
    span = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)  # over at most 2**20 counts
    bounds = [r["lo"] for r in per.select("_h", (F.coalesce(F.sum("n").over(span), F.lit(0)) / BLOCK_TERMS).cast("long").alias("b")).groupBy("b").agg(F.min("_h").alias("lo")).orderBy("lo").toLocalIterator()]
    for lo, hi in zip(bounds, [*bounds[1:], 1 << 20][: len(bounds)], strict=True):
        block: dict[object, list[bytes]] = {}
        for r in found.where((F.col("_h") >= lo) & (F.col("_h") < hi)).collect():
            block.setdefault(r["item_id"], []).append(r["term"].encode())
        yield list(block.items())
    forget(found)


def searched(shards: DataFrame, items: DataFrame, size: Corpus, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = shards.sparkSession
    item_kind, id_kind = items.schema["item_id"].dataType.simpleString(), shards.schema["doc_ids"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_kind}, doc_id {id_kind}, score long")
    for block in _blocks(items):
        wanted = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}

        def counted(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                    lengths = np.diff(np.frombuffer(starts.as_py(), "<i4"))
                    for i, t in enumerate(terms.as_py().split(b" ")):
                        if t in wanted:
                            df[wanted[t]] += lengths[i]
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

        df = {r["term"]: r["df"] for r in shards.select("terms", "starts").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the block's terms at most
        weights = {t: weight(size.documents, df.get(i, 0)) for t, i in wanted.items()}
        asked = [(item, terms, [weights[t] for t in terms]) for item, terms in block]

        def rank(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[int, object]]] = [[] for _ in asked]
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row["doc_ids"], row["terms"], row["starts"], row["impacts"], row["bits"])
                    for i, (_, terms, own) in enumerate(asked):
                        best[i] = shard.best(terms, own, best[i], k)
            rows = [(item, d, s) for (item, _, _), found in zip(asked, best, strict=True) for s, d in found]
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], ["item_id", "doc_id", "score"])

        kinds = [to_arrow_type(items.schema["item_id"].dataType), to_arrow_type(shards.schema["doc_ids"].dataType.elementType), pa.int64()]
        out = out.unionByName(stored(shards.select("doc_ids", "terms", "starts", "impacts", "bits").mapInArrow(rank, out.schema), "found"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    size = corpus(docs)
    shards = index(docs, size)
    found = searched(shards, items, size)
    forget(shards)
    return found


SQL = rf"""
WITH tf AS (
  SELECT rid, doc_id, term, count(*) AS tf
  FROM (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
        FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents))
  GROUP BY rid, doc_id, term),
len AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), whole),
scored AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM weighed JOIN tf USING (term) JOIN len USING (rid), whole
  GROUP BY item_id, rid)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {TOP}
"""
