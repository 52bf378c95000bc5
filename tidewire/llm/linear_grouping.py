"""Packing whole documents into few windows by linear grouping.

A document is cut only if it is longer than a window: into full windows, the first piece taking what is left over.
The pieces' histogram has no more entries than a window has tokens, and all of the plan is made on it:

* `classes` puts pieces longer than a share of the window in order of length and cuts the order into groups of
  equal cardinality; each length is rounded up to the longest of its group. Few sizes remain.
* `configurations` packs these sizes: columns are generated for the linear relaxation of the cutting-stock problem
  (a knapsack over the window finds the configuration that pays most at the current prices), and its basic
  solution is rounded down. So there are no more configurations than sizes.
* `plan` substitutes the documents' actual lengths, which are no longer than the sizes they stand for. Windows whose
  actual contents are equal form runs, at most as many as there are lengths and places in configurations.
* What rounding down left over, and the small pieces, go best-fit decreasing into what room there is.

Each piece then finds its place by its length and its rank among pieces of that length, as counts in buckets, so
that a length which a third of all pieces have is no task of its own. Neither ids nor texts are shuffled.

Defined results: a null text is empty and has the closing id alone; rows that are equal in id and text get the same
pieces, each in a place of its own; an empty table gives no rows; other columns are ignored, whatever their names; a
text of any length is tokenised whole; a null doc_id is an id like any other.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stored, text_key
from tidewire.llm.packing import CapacityTree, encoder, tokenizer_path
from tidewire.llm.sharding import with_slots

WINDOW = 1024
CLOSING_ID = 2
#: A piece is large if it takes more than one window in so many.
LARGE = 4
#: Groups of equal cardinality that large pieces are put into.
GROUPS = 256
#: Steps of the linear program for each size; what it holds then is a valid packing, if not the best.
STEPS = 60

Step = tuple[int, int, int, int, int]


def pieces(docs: DataFrame, window: int = WINDOW, closing_id: int = CLOSING_ID, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, fp (the text's fingerprint), piece, start, length, ids_crc32 and, if asked for, ids (32-bit little-endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path or tokenizer_path()), array("I", [closing_id]).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                of, numbers, raws = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    raw = encode(text or "") + end
                    n = len(raw) // 4
                    first = n % window or window
                    for k, (s, e) in enumerate(zip([0, *range(first, n, window)], range(first, n + 1, window), strict=True)):
                        of.append(i)
                        numbers.append((k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])))
                        if ids:
                            raws.append(raw[4 * s : 4 * e])
                at = pa.array(of, pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*numbers, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *columns, *[pa.array(raws, pa.binary())] * ids], names)

    names = ["doc_id", "fp", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("fp"), "text").mapInArrow(cut, f"doc_id {kind}, fp long, piece int, start long, length long, ids_crc32 long{', ids binary' * ids}")


def classes(histogram: dict[int, int], least: int, groups: int) -> list[tuple[int, int]]:
    """(size, pieces) of groups of equal cardinality, from the longest; pieces longer than `least` count, and groups of one size are one."""
    lengths = sorted((n for n in histogram if n > least), reverse=True)
    total = sum(histogram[n] for n in lengths)
    ends = list(accumulate(histogram[n] for n in lengths))
    out: list[tuple[int, int]] = []
    for g in range(groups):
        lo, hi = g * total // groups, (g + 1) * total // groups
        if lo < hi:
            size = lengths[bisect.bisect_right(ends, lo)]
            if out and out[-1][0] == size:
                out[-1] = (size, out[-1][1] + hi - lo)
            else:
                out.append((size, hi - lo))
    return out


def _dearest(sizes: np.ndarray, prices: np.ndarray, window: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes that fits into a window and has the highest price: a knapsack by number of items, of which the last is tried at the whole window only."""
    rooms, most = np.arange(window + 1), window // int(sizes.min())
    value, picks = np.zeros(window + 1), []
    for k in range(most):
        at = rooms if k < most - 1 else rooms[-1:]
        room = at[None, :] - sizes[:, None]
        more = np.where(room >= 0, value[np.maximum(room, 0)] + prices[:, None], -1.0)
        pick = more.argmax(0)
        best = more[pick, np.arange(len(at))]
        better = best > value[at] + 1e-12
        if not better.any():
            break
        picks.append(dict(zip(at[better].tolist(), pick[better].tolist(), strict=True)))
        value = value.copy()
        value[at[better]] = best[better]
    column, c = np.zeros(len(sizes)), window
    for pick in reversed(picks):
        if c in pick:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return column, float(value[window])


def configurations(sized: list[tuple[int, int]], window: int) -> list[tuple[list[int], int]]:
    """(copies of each size, windows packed like that): the linear relaxation's basic solution, rounded down.

    The relaxation counts as solved once its windows over the highest price, which bound it from below, are less than one window apart.
    """
    if not sized:
        return []
    sizes, wanted = np.array([s for s, _ in sized]), np.array([float(n) for _, n in sized])
    fit = (window // sizes).astype(float)
    basis, inverse = np.diag(fit), np.diag(1 / fit)
    now = wanted / fit
    for _ in range(STEPS * len(sizes)):
        column, value = _dearest(sizes, np.maximum(inverse.sum(0), 0), window)
        toward = (inverse * column).sum(1)
        if now.sum() * (1 - 1 / value) < 1 or not (toward > 1e-9).any():
            break
        ratio = np.where(toward > 1e-9, np.maximum(now, 0) / np.where(toward > 1e-9, toward, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = column
        row = inverse[leave] / toward[leave]
        now -= ratio[leave] * toward
        now[leave] = ratio[leave]
        toward[leave] -= 1
        inverse -= np.outer(toward, row)
    times = np.floor(now + 1e-6).astype(int)
    left, out = wanted.astype(int), []
    for j in np.argsort(-times, kind="stable"):
        copies = basis[:, j].astype(int)
        fits = min(int(times[j]), *(int(left[i] // copies[i]) for i in np.flatnonzero(copies)))  # rounding must not take what isn't there
        if fits > 0:
            out.append((copies.tolist(), fits))
            left -= copies * fits
    return out


class _Stock:
    """Pieces by length from the longest, taken in that order within each class."""

    def __init__(self, histogram: dict[int, int], sized: list[tuple[int, int]]):
        self.lengths = sorted(histogram, reverse=True)
        self.ends = list(accumulate(histogram[n] for n in self.lengths))
        self.histogram = histogram
        self.next = [0, *accumulate(n for _, n in sized)][: len(sized)]

    def at(self, position: int) -> tuple[int, int, int]:
        """length, rank among its length, and how many of that length follow from there on."""
        k = bisect.bisect_right(self.ends, position)
        n = self.lengths[k]
        return n, position - (self.ends[k] - self.histogram[n]), self.ends[k] - position


def best_fit(tree: CapacityTree, left: dict[int, list[tuple[int, int]]], windows: int, window: int) -> tuple[list[Step], int]:
    """Steps that put `left`, ranges (rank, pieces) by length, from long to short into the tightest windows, and the number of windows then."""
    steps: list[Step] = []
    for n in sorted(left, reverse=True):
        for rank, count in left[n]:
            while count:
                room = tree.tightest(n)
                if room:
                    first, many, used = tree.pop(room)
                else:
                    room, first, used = window, windows, 0
                    many = -(-count // (window // n))
                    windows += many
                for per, runs in ((room // n, min(many, count // (room // n))), (count % (room // n), 1)):  # windows that are filled, then one that isn't
                    if per and runs and many and count >= per * runs and (runs > 1 or per * runs <= count):
                        steps.append((n, rank, first, per, used))
                        tree.push(room - per * n, (first, runs, used + per * n))
                        rank, count, first, many = rank + per * runs, count - per * runs, first + runs, many - runs
                if many:
                    tree.push(room, (first, many, used))
    return steps, windows


def plan(histogram: dict[int, int], window: int = WINDOW, large: int = LARGE, groups: int = GROUPS) -> tuple[list[Step], int]:
    """Steps (length, first rank, first window, pieces per window, offset) that pack all lengths, and the number of windows."""
    tree, steps, windows = CapacityTree(window), [], 0
    sized = classes(histogram, window // large, groups)
    stock = _Stock(histogram, sized)
    for copies, times in configurations(sized, window):
        slots = []
        for i, n in enumerate(copies):
            for _ in range(n):
                slots.append(stock.next[i])
                stock.next[i] += times
        done = 0
        while done < times:
            inside = [stock.at(s + done) for s in slots]
            run, used = min(times - done, *(more for _, _, more in inside)), 0
            for n, rank, _ in inside:
                steps.append((n, rank, windows, 1, used))
                used += n
            tree.push(window - used, (windows, run, used))
            windows, done = windows + run, done + run
    left: dict[int, list[tuple[int, int]]] = {n: [(0, histogram[n])] for n in histogram if n <= window // large}
    ends = list(accumulate(n for _, n in sized))
    for at, end in zip(stock.next, ends, strict=True):
        while at < end:
            n, rank, more = stock.at(at)
            left.setdefault(n, []).append((rank, min(more, end - at)))
            at += min(more, end - at)
    more, windows = best_fit(tree, left, windows, window)
    return steps + more, windows


def packed(docs: DataFrame, window: int = WINDOW, closing_id: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """doc_id, fp, piece, start, length, ids_crc32, sequence_id and offset of each piece; the ids don't travel, `sequences` brings them together."""
    cut = stored(pieces(docs, window, closing_id, path), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # no more rows than a window has tokens
    n_rows = sum(histogram.values())
    full = histogram.pop(window, 0)
    steps, windows = plan(histogram, window)
    ranked = with_slots(cut.withColumn("_u", F.xxhash64("doc_id", "fp", "start")), "length", [F.col("_u"), F.col("doc_id"), F.col("fp"), F.col("start")], F.col("_u"), n_rows, "_place")
    by_length: dict[int, list[tuple[int, int, int, int]]] = {window: [(0, windows, 1, 0)]} if full else {}
    for n, rank, first, per, used in sorted(steps):
        by_length.setdefault(n, []).append((rank, first, per, used))
    tables = {n: np.array(rows, np.int64).T for n, rows in by_length.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_place"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                ranks, first, per, used = tables[int(n)]
                k = np.searchsorted(ranks, rank[mine], "right") - 1
                sequence[mine] = first[k] + (rank[mine] - ranks[k]) // per[k]
                offset[mine] = used[k] + (rank[mine] - ranks[k]) % per[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "fp", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.select(*names).dtypes)
    return ranked.select(*names, "_place").mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, window: int = WINDOW, closing_id: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """sequence_id, ids (binary, 32-bit little-endian) and n_tokens of each window: what a trainer reads. Moves all ids once."""
    text = pieces(docs, window, closing_id, path, ids=True).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("start").alias("_s"), "ids").dropDuplicates(["_d", "_f", "_s"])
    both = packed(docs, window, closing_id, path).join(text, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")) & (F.col("start") == F.col("_s")))
    whole = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "n_tokens")


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
