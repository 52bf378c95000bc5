"""Removal of repeated byte strings by external induced sorting.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting every suffix of a
corpus is not needed to find these strings: each window of LENGTH bytes is owned by its anchor, the least
hashed GRAM in it (the leftmost of equals), which its content alone decides, so equal windows have anchors of
equal hash at equal distance. Windows that follow each other and share an anchor are one segment.

- Segments that are equal, as those of copies are, are settled by their hash and count; one stands for all.
- Different segments around equal anchors are shuffled by the anchor's hash and sorted: the suffixes that start at
  the anchors, and the reversed prefixes that end there. Sorting is by induction from the end, eight bytes at a
  time: a suffix is the tuple (block, rank of the rest), tuples pass through a priority queue whose sorted runs go
  to disk, and the common prefix of neighbours is induced along with the ranks, from the rest's common prefixes by
  range minima. For each distance to the anchor, windows are equal if right and left neighbours share enough, which
  cuts both orders into classes.
- An anchor with more than HOT different segments, as the edge of a passage that very many texts quote, is dealt
  further: in a band of distances every window holds the same stretch around the anchor, so windows can only be equal
  to those whose stretch is equal. Segments are cut to the bands and keyed by that stretch; equal pieces are settled by
  count again, and what is still too many goes on to narrower bands. In a band of one distance the stretch is the
  whole window, so nothing is left to sort. No task holds an anchor, whatever its share of the rows.

A task sorts BATCH segments at a time, or a few more so as not to part a key: of these it holds the bytes (twice, as
Arrow and by side) and ranks. The blocks of a batch above QUEUE segments are a memory map and its queue's runs are files,
in Spark's own local folders, like Spark's spill files; both go when the batch is done.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows that are equal in every
way are places of their own, so all of a long one goes; matches never cross documents; bytes are cut, so a
kept text may end within a character; an empty table gives no rows; other columns are ignored,
whatever their names. A text of any length is read whole, in overlapping stretches; of windows that tie in
their least hash the leftmost gram is the anchor.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stored, text_key

LENGTH = 400
GRAM = 64
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20
#: Segments sorted at a time; tuples a queue keeps in memory.
BATCH = 12_000
QUEUE = 4_096
#: A key with more different segments than this is dealt by bands of so many distances, then of fewer; small, so that tables of every size go the same way.
HOT = 512
BANDS = (43, 7, 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes, by doubling."""
    h, width, base = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), width * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive keys: of a block's end and the next block's beginning."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's hash, anchor, first window, last window) of each segment, all as positions in the text."""
    data, width = np.frombuffer(raw, np.uint8), LENGTH - GRAM + 1
    low = np.uint64((1 << 21) - 1)
    for at in range(0, len(data) - LENGTH + 1, STRETCH):
        part = data[at : at + STRETCH + LENGTH - 1]
        h = gram_hashes(part)
        keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals is least
        owner = (window_minima(keys, width) & low).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        ends = np.r_[starts[1:], len(owner)] - 1
        anchors = owner[starts]
        yield from zip(h[anchors].view(np.int64).tolist(), (anchors + at).tolist(), (starts + at).tolist(), (ends + at).tolist(), strict=True)


def anchored(docs: DataFrame) -> DataFrame:
    """f, g (hashes of anchor and segment), doc_id, fp, n (1), a, lo, hi of every segment."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                of, rows = [], []
                for i, raw in enumerate(part.column("raw").to_pylist()):
                    for f, a, lo, hi in segments(raw) if raw is not None else ():
                        of.append(i)
                        rows.append((f, xxhash.xxh3_64_intdigest(raw[lo : hi + LENGTH], a - lo) - (1 << 63), a, lo, hi))
                ids = pa.array(of, pa.int64())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:2], part.column("doc_id").take(ids), part.column("fp").take(ids), *columns[2:]], ["f", "g", "doc_id", "fp", "a", "lo", "hi"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "fp", F.col("text").cast("binary").alias("raw")).mapInArrow(find, f"f long, g long, doc_id {kind}, fp long, a int, lo int, hi int")
    return found.withColumn("n", F.lit(1).cast("long"))


def banded(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """rows (f, doc_id, fp, n, a, lo, hi, seg) cut to bands of `width` distances to the anchor, with f, the hash of what all windows of the band hold, and g, that of the piece."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                of, out = [], []
                for i, (f, a, lo, hi, seg) in enumerate(zip(*(part.column(c).to_pylist() for c in ("f", "a", "lo", "hi", "seg")), strict=True)):
                    for band in range((a - hi) // width, (a - lo) // width + 1):
                        near, far = max(a - hi, band * width), min(a - lo, band * width + width - 1)
                        inner, outer = band * width, min(band * width + width - 1, LENGTH - GRAM)
                        at = a - lo  # the anchor's place in seg
                        held = seg[at - min(inner, at) : at + LENGTH - outer]
                        piece = seg[at - far : at - near + LENGTH]
                        of.append(i)
                        out.append((xxhash.xxh3_64_intdigest(held, (f * 512 + band) & 0xFFFFFFFFFFFFFFFF) - (1 << 63), xxhash.xxh3_64_intdigest(piece, far) - (1 << 63), a - far, a - near, piece))
                ids = pa.array(of, pa.int64())
                made = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*made[:2], *(part.column(c).take(ids) for c in ("doc_id", "fp", "n", "a")), *made[2:]], ["f", "g", "doc_id", "fp", "n", "a", "lo", "hi", "seg"])

    return rows.mapInArrow(deal, f"f long, g long, doc_id {kind}, fp long, n long, a int, lo int, hi int, seg binary")


class SuffixQueue:
    """A priority queue of suffix tuples (block, rank of the rest, number): sorted runs go to disk beyond a limit, and come out merged."""

    def __init__(self, folder: str, limit: int = QUEUE):
        self.folder, self.limit, self.held, self.size, self.runs = folder, limit, [], 0, []

    def push(self, block: np.ndarray, rank: np.ndarray, number: np.ndarray) -> None:
        self.held.append((block, rank, number))
        self.size += len(block)
        if self.size >= self.limit:
            path = f"{self.folder}/run{len(self.runs)}"
            for i, x in enumerate(self._sorted()):
                np.save(f"{path}.{i}.npy", x)
            self.runs.append(path)

    def _sorted(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)] if self.held else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.held, self.size = [], 0
        order = np.lexsort((columns[1], columns[0]))
        return [c[order] for c in columns]

    def pop_all(self) -> Iterator[list[np.ndarray]]:
        """All tuples in order, in chunks; equal tuples may meet across chunks."""
        if not self.runs:
            yield self._sorted()
            return
        runs = [[np.load(f"{p}.{i}.npy", mmap_mode="r") for i in range(3)] for p in self.runs]
        if self.size:
            runs.append(self._sorted())
        at, step = [0] * len(runs), max(1, self.limit // len(runs))
        while any(a < len(r[0]) for a, r in zip(at, runs, strict=True)):
            # up to the least of the last keys of the runs' next pieces, nothing smaller can come later
            heads = [(r[0][min(a + step, len(r[0])) - 1], r[1][min(a + step, len(r[0])) - 1]) for a, r in zip(at, runs, strict=True) if a < len(r[0])]
            top = min(heads)
            pieces = []
            for k, r in enumerate(runs):
                piece = [np.asarray(c[at[k] : at[k] + step]) for c in r]
                n = int(((piece[0] < top[0]) | ((piece[0] == top[0]) & (piece[1] <= top[1]))).sum())
                pieces.append([c[:n] for c in piece])
                at[k] += n
            columns = [np.concatenate(c) for c in zip(*pieces, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            yield [c[order] for c in columns]


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) for arrays of ranges, by a table of minima over powers of two."""
    out = np.empty(len(first), values.dtype)
    length = last - first + 1
    power = np.frexp(length.astype(np.float64))[1] - 1
    table, k = values, 0
    while True:
        use = power == k
        if use.any():
            out[use] = np.minimum(table[first[use]], table[last[use] - (1 << k) + 1])
        if not (power > k).any():
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def induced(blocks: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """rank of each string, equal strings having equal ranks, and common[d], the bytes that the strings of ranks d - 1 and d share.

    blocks[j] holds the j-th eight bytes of each string, as a number; it may be a memory map.
    """
    m = blocks.shape[1]
    rank, common = np.zeros(m, np.int64), np.zeros(1, np.int64)
    for level in range(blocks.shape[0] - 1, -1, -1):
        queue = SuffixQueue(tempfile.mkdtemp(dir=folder))
        for lo in range(0, m, QUEUE):
            queue.push(np.asarray(blocks[level][lo : lo + QUEUE]), rank[lo : lo + QUEUE], np.arange(lo, min(m, lo + QUEUE)))
        new, keys, ranks, last, d = np.empty(m, np.int64), [], [], None, -1
        for b, r, number in queue.pop_all():
            if not len(b):
                continue
            differs = np.r_[last is None or (b[0], r[0]) != last, (b[1:] != b[:-1]) | (r[1:] != r[:-1])]
            new[number] = d + np.cumsum(differs)
            d += int(differs.sum())
            keys.append(b[differs])
            ranks.append(r[differs])
            last = (b[-1], r[-1])
        shutil.rmtree(queue.folder)
        b, r = np.concatenate(keys), np.concatenate(ranks)
        apart = b[1:] ^ b[:-1]
        shared = np.zeros(len(b), np.int64)
        for bits in range(8, 64, 8):  # leading bytes that are equal
            shared[1:] += apart < np.uint64(1 << bits)
        same = np.flatnonzero(apart == 0) + 1
        if len(same):
            shared[same] = 8 + range_minima(common, r[same - 1] + 1, r[same])
        rank, common = new, shared
    return rank, common


def as_blocks(strings: list[bytes], width: int, folder: str) -> np.ndarray:
    """Strings, filled up with zeros, as rows of blocks; a memory map if a queue would not hold them."""
    levels = -(-width // 8)
    shape = (levels, len(strings))
    out = np.memmap(f"{folder}/blocks", np.uint64, "w+", shape=shape) if len(strings) > QUEUE else np.empty(shape, np.uint64)
    for lo in range(0, len(strings), QUEUE):
        part = strings[lo : lo + QUEUE]
        flat = np.frombuffer(b"".join(s.ljust(levels * 8, b"\0") for s in part), ">u8").reshape(len(part), levels)
        out[:, lo : lo + len(part)] = flat.T
    return out


def scratch() -> str | None:
    """One of Spark's local folders, dealt by task; the worker's own temporary folder where Spark names none."""
    from pyspark import TaskContext

    dirs = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    task = TaskContext.get()
    return dirs[task.partitionId() % len(dirs) if task else 0] if dirs else None


def repeated_windows(left: list[bytes], right: list[bytes], near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, least, most distance to the anchor) of the runs of windows that another segment has too.

    left are the reversed bytes before the anchors; a segment's windows start near..far bytes before its anchor.
    """
    folder = tempfile.mkdtemp(prefix="suffix-", dir=scratch())
    try:
        os.mkdir(f"{folder}/l")
        rank_r, common_r = induced(as_blocks(right, LENGTH, folder), folder)
        rank_l, common_l = induced(as_blocks(left, LENGTH - GRAM, f"{folder}/l"), f"{folder}/l")
        opened = np.full(len(near), -1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for o in range(int(near.min()), int(far.max()) + 2):
            active = np.flatnonzero((near <= o) & (o <= far))
            cut_r, cut_l = common_r < LENGTH - o, common_l < o
            cut_r[0] = cut_l[0] = True
            key = np.cumsum(cut_r)[rank_r[active]] * (len(common_l) + 1) + np.cumsum(cut_l)[rank_l[active]]
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = active[order[np.r_[False, same] | np.r_[same, False]]] if len(key) else active
            now = np.zeros(len(near), bool)
            now[twice] = True
            closed = np.flatnonzero((opened >= 0) & ~now)
            out.append((closed, opened[closed], np.full(len(closed), o - 1)))
            opened[closed] = -1
            opened[now & (opened < 0)] = o
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def sorted_segments(rows: DataFrame, kind: str) -> DataFrame:
    """rows (f, doc_id, fp, n, a, lo, hi, seg) of different segments to doc_id, fp and the runs of window starts (lo, hi) that occur elsewhere."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["doc_id", "fp", "lo", "hi"]

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            a, lo, hi, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "lo", "hi", "n"))
            seg = table.column("seg").to_pylist()
            left = [s[:k][::-1] for s, k in zip(seg, (a - lo).tolist(), strict=True)]
            right = [s[k:] for s, k in zip(seg, (a - lo).tolist(), strict=True)]
            which, least, most = repeated_windows(left, right, a - hi, a - lo)
            own = n[which] == 1  # the others are settled
            which, least, most = which[own], least[own], most[own]
            of = pa.array(which)
            combined = table.combine_chunks()
            take = lambda c: combined.column(c).combine_chunks().take(of)
            yield pa.RecordBatch.from_arrays([take("doc_id"), take("fp"), pa.array(a[which] - most), pa.array(a[which] - least)], names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            table = pa.Table.from_batches(held)
            f = table.column("f").to_numpy()
            cut = int(np.flatnonzero(f != f[-1]).max(initial=-1)) + 1  # the last key may go on
            if cut:
                yield from done(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from done(pa.Table.from_batches(held))

    return rows.mapInArrow(work, f"doc_id {kind}, fp long, lo long, hi long")


def same_document(d: str, f: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("fp") == F.col(f))


def settled(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The runs of windows whose segment of found (f, g, doc_id, fp, n, a, lo, hi and what more) is there twice, and one row for each different segment, with n > 1 if it is settled."""
    rest = [c for c in found.columns if c not in ("f", "g", "n")]
    classes = found.groupBy("f", "g").agg(F.count("*").alias("rows"), F.max("n").alias("most"), *(F.first(c).alias(c) for c in rest))
    classes = stored(classes.withColumn("n", F.greatest("rows", "most")).drop("most"), f"{name}-classes")
    equal = found.join(classes.where("rows > 1").select("f", "g"), ["f", "g"]).select("doc_id", "fp", F.col("lo").cast("long"), F.col("hi").cast("long"))
    return equal, classes.drop("rows")


def shared_keys(classes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The keys f of two to HOT different segments, and those of more."""
    keys = stored(classes.groupBy("f").agg(F.count("*").alias("k")).where("k > 1"), f"{name}-keys")
    return keys.where(F.col("k") <= HOT).select("f"), keys.where(F.col("k") > HOT).select("f")


def cut_out(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """f, doc_id, fp, n, a, lo, hi of classes, with `seg`, the bytes of each."""
    asked = classes.groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(F.collect_list(F.struct("f", "n", "a", "lo", "hi")).alias("wanted"))  # of one text
    texts = docs.join(asked, same_document("_d", "_f")).select("doc_id", "fp", F.col("text").cast("binary").alias("raw"), F.explode("wanted").alias("w"))
    return texts.select("w.f", "doc_id", "fp", "w.n", "w.a", "w.lo", "w.hi", F.expr(f"substring(raw, w.lo + 1, w.hi - w.lo + {LENGTH})").alias("seg"))


def by_key(rows: DataFrame) -> DataFrame:
    return rows.select("f", "doc_id", "fp", "n", "a", "lo", "hi", "seg").repartition("f").sortWithinPartitions("f")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """doc_id, fp, lo, hi: runs of positions at which a string of LENGTH bytes starts that also starts elsewhere. docs has doc_id, fp, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(anchored(docs), "segments")
    equal, classes = settled(found, "segment")
    few, many = shared_keys(classes, "segment")
    out = equal.unionByName(sorted_segments(by_key(cut_out(docs, classes.join(few, "f"))), kind))
    if not many.limit(1).count():
        return out
    hot = stored(cut_out(docs, classes.join(many, "f")), "hot-segments")
    for width in BANDS:
        equal, classes = settled(stored(banded(hot, width, kind), f"bands-{width}"), f"band-{width}")
        few, many = shared_keys(classes, f"band-{width}")
        out = out.unionByName(equal).unionByName(sorted_segments(by_key(classes.join(few, "f")), kind))
        if not many.limit(1).count():
            break
        hot = classes.join(many, "f")
    return out


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the kept bytes and the removed spans (start, end) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("fp"), "text")
    runs = repeated_starts(keyed).groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                n, kept, spans = [], [], []
                for raw, runs in zip(part.column("raw").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for lo, hi in sorted((r["lo"], r["hi"] + LENGTH) for r in runs or ()):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    raw = raw or b""
                    edges = [0, *(x for s in merged for x in s), len(raw)]
                    n.append(len(raw))
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "kept", "spans"])

    both = keyed.join(runs, same_document("_d", "_f"), "left").select("doc_id", F.col("text").cast("binary").alias("raw"), "runs")
    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")


def digest(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    told = cleaned(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return stored(told, "suffix-digest")
