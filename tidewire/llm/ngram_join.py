"""Self-join of documents on the Jaccard similarity of word n-grams, size-aware and heavy-light.

A document is the set of its shingles. Equal sets are one class; everything below is on classes. In one
global order of shingles, two sets that are similar enough share their k least common elements within the
first n - ceil(t * n) + k elements of each. Two ways use this:

- light: of small sets every pair (a subset of fixed size two) of that prefix is enumerated (k = 2), and
  sets that share a subset are candidates;
- heavy: of large sets, and of those small ones that could be similar to a large one, the prefix with
  k = 1 goes into inverted lists, which are scanned.

The boundary between small and large is where enumerating costs more than scanning: a place in a list costs a row,
and a candidate if the list has another member. How often it has is measured for elements and for pairs, on a
sample of documents. A list gives each member one candidate, so pairs can only pay up to a prefix of
2 * (1 + CANDIDATE) elements. The order puts shingles that are frequent in the sample last, so that passages shared by
very many documents are in hardly any prefix. Any order and any boundary give the same result.

A text is read once: its size, its class, a sketch and what it is indexed under are written beside each other, and the
lists are made of them. Texts are read again only of sets that have a candidate.

Candidates pass a bound (from 128 counts per set, which never excludes a link) and then an exact count.
Lists first link their members to one of them, the pivot; what that leaves in different components is
compared pair by pair, within classes of size and only where the places in both sets leave enough to share. So a large
group of near copies costs links in proportion to its size, and no link between components is lost.

Defined results: a null text, or one without words, has an empty set and links with nothing; fewer words
than a shingle are one shingle, the whole sequence; rows that are equal in doc_id and text are one
document with a row each; a null doc_id is never a component's name while another id is there; an empty
table gives no rows; other columns are ignored by `joined`, whatever their names; a text of any length is read
whole; sets that tie in what they share with a list take its pivot by the greater class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import forget, stored, text_key
from tidewire.llm.components import components

#: Of so many documents one is sampled to find frequent shingles; so many of those are put last.
SAMPLE_ONE_IN = 16
FREQUENT = 200_000
BINS = 128
#: What comparing a candidate costs, in rows of a list.
CANDIDATE = 4
#: Memory that a task's remembered words may take, about, and rows that it works on at a time.
WORD_BYTES, SLICE = 30 << 20, 256
#: Up to so many classes (under 10 MB) are sent to the texts, rather than all texts to them.
SENT = 200_000


class WordHashes(dict):
    """64-bit hashes of words, the latest ones remembered."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if self.held > WORD_BYTES:
            self.clear()
            self.held = 0
        self.held += 150 + len(word)
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    k = min(size, len(w))
    acc = np.full(len(w) - k + 1, (k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : len(h) - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def least_common(n: int, threshold: int) -> int:
    """How many elements a set of n shares at least with any similar set."""
    return -(-threshold * n // 100)


def ordered(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The elements of a set in the global order: those of `last` behind the others."""
    if not len(last):
        return s
    is_last = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
    return np.concatenate([s[~is_last], s[is_last]])


def singles(s: np.ndarray, threshold: int) -> np.ndarray:
    """The prefix of an ordered set that goes into inverted lists."""
    return s[: len(s) - least_common(len(s), threshold) + 1]


def pairs(s: np.ndarray, threshold: int) -> np.ndarray:
    """All pairs of an ordered set's prefix, hashed."""
    p = s[: len(s) - least_common(len(s), threshold) + 2]
    i, j = np.triu_indices(len(p), 1)
    lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
    return np.unique((lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi + (lo >> np.uint64(29))))


def is_light(n: int, light_to: int, threshold: int) -> bool:
    return n <= light_to and least_common(n, threshold) >= 2


def is_heavy(n: int, light_to: int, threshold: int) -> bool:
    """Whether a set of n is large or can be similar to a large one."""
    return n > light_to or n >= ceil(threshold * (light_to + 1) / 100) or least_common(n, threshold) < 2


def may_be_light(n: int, threshold: int) -> bool:
    """Whether enumerating the pairs of a set of n can cost less than scanning its lists."""
    return n - least_common(n, threshold) + 1 < 2 * (1 + CANDIDATE)


def boundary(histogram: dict[int, int], shared: float, pair_shared: float, threshold: int) -> int:
    """The size up to which enumerating pairs of the prefix is cheaper than scanning lists, given the shares of elements and of pairs that another set has too."""
    n = np.array(sorted(histogram), np.int64)
    if not len(n):
        return 0
    many = np.array([histogram[x] for x in n.tolist()], np.float64)
    spare = n + (-threshold * n // 100)
    light = np.cumsum(many * (spare + 2) * (spare + 1) / 2 * (1 + CANDIDATE * pair_shared))
    heavy = np.cumsum(many * (spare + 1) * (1 + CANDIDATE * shared))
    best = (heavy[-1], 0)
    for i, x in enumerate(n.tolist()):
        below = np.searchsorted(n, ceil(threshold * (x + 1) / 100))  # from here on both ways are needed
        best = min(best, (light[i] + heavy[-1] - (heavy[below - 1] if below else 0.0), x))
    return best[1]


def scouted(docs: DataFrame, size: int, threshold: int) -> tuple[np.ndarray, int]:
    """The most frequent shingles of a sample, at most FREQUENT, and the boundary that the sample's lists make cheapest. docs has fp and text."""
    # the sample is by text, so that copies count once
    sample = stored(docs.where(F.pmod(F.col("fp"), F.lit(SAMPLE_ONE_IN)) == 0).select("fp", "text").dropDuplicates(["fp"]).select("text"), "sample")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                found = [shingles(t, size, hashes) for t in batch.slice(lo, SLICE).column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64), pa.int64())], ["s"])

    counts = sample.mapInArrow(emit, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    last = np.sort(counts.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind and token: 0 an element, 1 an element of a set too large for pairs, 2 a pair, and once for each set less than 0, its size (from 64 on as a power of two)."""
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                kinds, tokens = [], []
                for text in batch.slice(lo, SLICE).column("text").to_pylist():
                    s = ordered(shingles(text, size, hashes), sent.value)
                    n = len(s)
                    if n:
                        small = may_be_light(n, threshold)
                        found = [(0 if small else 1, singles(s, threshold)), (-(n if n <= 64 else 1 << (n - 1).bit_length()), np.zeros(1, np.uint64)), *([(2, pairs(s, threshold))] if small else [])]
                        kinds += [np.full(len(t), k, np.int64) for k, t in found]
                        tokens += [t.view(np.int64) for _, t in found]
                if kinds:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds), pa.int64()), pa.array(np.concatenate(tokens), pa.int64())], ["kind", "token"])

    k = F.col("kind")
    lists = sample.mapInArrow(index, "kind long, token long").groupBy(F.when(k == 1, 0).otherwise(k).alias("kind"), "token").agg(F.count("*").alias("n"), F.sum((k != 1).cast("long")).alias("small"))
    met = F.sum(F.when(F.col("n") > 1, F.col("small")).otherwise(0))
    told = {r["kind"]: r for r in lists.groupBy("kind").agg(F.sum("small").alias("small"), met.alias("met")).collect()}  # a row per size, of which there are at most 64 and 60 powers of two
    # of two sets that share an element both are in the sample once in SAMPLE_ONE_IN times
    shares = [min(1.0, SAMPLE_ONE_IN * told[x]["met"] / max(1, told[x]["small"])) if x in told else 0.0 for x in (0, 2)]
    forget(sample)
    return last, boundary({-x: r["small"] for x, r in told.items() if x < 0}, *shares, threshold)


def sets(docs: DataFrame, size: int, threshold: int, last: np.ndarray, light_to: int) -> DataFrame:
    """doc_id, fp, n, class (hash of the set; null if empty), counts (of BINS bins, one byte each), heavy and light (what the set is indexed under)."""
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                n, ids, counts, heavy, light = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text, size, hashes)
                    n.append(len(s))
                    ids.append(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) if len(s) else None)
                    counts.append(np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() if len(s) else None)
                    in_order = ordered(s, sent.value)
                    heavy.append(singles(in_order, threshold).view(np.int64) if len(s) and is_heavy(len(s), light_to, threshold) else [])
                    light.append(pairs(in_order, threshold).view(np.int64) if len(s) and is_light(len(s), light_to, threshold) else [])
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fp"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(counts, pa.binary()), pa.array(heavy, longs), pa.array(light, longs)], ["doc_id", "fp", "n", "class", "counts", "heavy", "light"])

    return docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, n long, class long, counts binary, heavy array<long>, light array<long>")


def lists(classes: DataFrame) -> DataFrame:
    """token, class, n, at (the token's place in the ordered set; 0 of a pair): the members of every list of two classes or more."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of token, those whose token a neighbour shares; one row is held back between batches."""
        held = None  # the last row so far, and whether it has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("token").to_numpy()
            same = t[1:] == t[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            if held is not None and held[0].column("token")[0].as_py() == t[0]:
                keep[0] = True
                if not held[1]:
                    yield held[0]
            if keep.any():
                yield batch.filter(pa.array(keep))
            held = (batch.slice(batch.num_rows - 1, 1), bool(keep[-1]))

    n = F.col("n").cast("int").alias("n")
    heavy = classes.select("class", n, F.posexplode("heavy").alias("at", "token"))
    light = classes.select("class", n, F.lit(0).alias("at"), F.explode("light").alias("token"))
    postings = heavy.unionByName(light).select("token", "class", "n", "at")
    return postings.repartition("token").sortWithinPartitions("token").mapInArrow(repeated, "token long, class long, n int, at int")


def similar(pairs: DataFrame, first: DataFrame, docs: DataFrame, size: int, threshold: int) -> tuple[DataFrame, list[DataFrame]]:
    """Of pairs (a, b) of classes those that link: bound by counts, then exact intersection of the two sets. And the stored tables that this reads."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("ca", "cb"))
                apart = np.abs(x - y).sum(1, dtype=np.int64)
                total = part.column("na").to_numpy() + part.column("nb").to_numpy()
                yield part.select(["a", "b", "na", "nb"]).filter(pa.array((100 + threshold) * apart <= (100 - threshold) * total))

    side = lambda x: first.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    sized = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    near = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(sized).mapInArrow(bound, "a long, b long, na long, nb long"), "near-pairs")
    need = near.select(F.col("a").alias("class")).union(near.select("b")).distinct()
    wanted = stored(need.join(first, "class").select("class", F.col("doc_id").alias("_d"), F.col("fp").alias("_f")), "wanted-sets")
    whole = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    texts = docs.join(whole, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f"))).select("class", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                made = [shingles(t, size, hashes).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(made, pa.list_(pa.int64()))], ["class", "s"])

    full = stored(texts.mapInArrow(make, "class long, s array<long>").dropDuplicates(["class"]), "sets")
    both = near.join(full.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", "na", "nb", common.cast("long").alias("c")).where(100 * F.col("c") >= threshold * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")
    return links, [near, wanted, full]


def joined(docs: DataFrame, size: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, fp, n and component, the class that stands for all documents that links (or equal sets) reach; null if the set is empty.

    threshold is in hundredths.
    """
    docs = docs.select("doc_id", text_key(F.col("text")).alias("fp"), "text")
    last, light_to = scouted(docs, size, threshold)
    indexed = stored(sets(docs, size, threshold, last, light_to), "shingle-sets")
    members = indexed.select("doc_id", "fp", "n", "class")
    standing = indexed.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "fp", "n", "counts", "heavy", "light")).alias("r"))
    classes = stored(standing.select("class", "r.*"), "classes")
    first = classes.drop("heavy", "light")
    found = stored(lists(classes), "lists")
    # the pivot of a list is the member that shares most with others: of edited copies the one with the fewest edits
    lengths = found.groupBy("token").agg(F.count("*").alias("len"))
    shared = found.join(lengths, "token").groupBy("class").agg(F.sum("len").alias("shared"))
    pivots = found.join(shared, "class").groupBy("token").agg(F.max_by("class", F.struct("shared", "class")).alias("a"))
    star = stored(found.join(pivots, "token").where("a <> class").select("a", F.col("class").alias("b")).distinct(), "star")
    links, read = similar(star, first, docs, size, threshold)
    reach = stored(components(links), "star-components").withColumnRenamed("node", "class")
    placed = found.join(reach, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # lists that still meet several components: compare across them
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    open_lists = stored(placed.join(mixed, "token"), "open-lists")
    across = crossing(open_lists, threshold).join(star, ["a", "b"], "left_anti")
    more, read_more = similar(across, first, docs, size, threshold)
    named = lambda x: reach.select(F.col("class").alias(x), F.col("component").alias(f"x{x}"))
    between = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("xa", "a").alias("a"), F.coalesce("xb", "b").alias("b"))
    joint = components(between).select(F.col("node").alias("component"), F.col("component").alias("_joint"))
    forget(classes, found, star, open_lists, *read, *read_more)  # all links are in the components
    placed = members.join(reach, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return placed.join(joint, "component", "left").select("doc_id", "fp", "n", F.coalesce("_joint", "component").alias("component"))


def crossing(open_lists: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a < b) of classes that a list brings together, of different components and able to be similar by size and place.

    Sizes fall into bands in which the ratio of two sizes is the threshold's, so similar sets are in the same or in neighbouring bands.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold + 1e-9))) if threshold < 100 else F.col("n").cast("long")
    banded = open_lists.withColumn("band", band)
    left = banded.select("token", "band", F.col("class").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("component").alias("xa"))
    right = banded.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("class").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("component").alias("xb"))
    # the first shingle that two sets share has at most so many of either before it as the other may lack
    least = F.expr(f"({threshold} * (na + nb) + {99 + threshold}) div {100 + threshold}")
    able = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (F.col("ia") <= F.col("na") - least) & (F.col("ib") <= F.col("nb") - least)
    return left.join(right, ["token", "band"]).where("a < b AND xa <> xb").where(able).select("a", "b").distinct()


def digest(docs: DataFrame, size: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    found = stored(joined(docs, size, threshold), "joined")
    ids = found.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which no similar document with a lesser doc_id is reached; documents without words stay."""
    found = stored(joined(docs, size, threshold), "joined")
    keep = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("doc_id"), F.col("k.fp").alias("fp")).union(found.where("component IS NULL").select("doc_id", "fp").distinct())
    keep = keep.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"))
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d0"), text_key(F.col("text")).alias("_f0"))
    same: Column = F.col("_d0").eqNullSafe(F.col("_d")) & (F.col("_f0") == F.col("_f"))
    return row.join(keep, same, "left_semi").select("_row.*")
