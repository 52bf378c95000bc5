"""Packing documents into sequences by best-fit decreasing.

`pieces` turns each document into token ids, once, and cuts what is longer than a window into full
windows; only remainders, shorter than a window, need packing. Best fit depends on lengths alone, so
it is planned on the histogram of lengths, which has less than a window of entries whatever the size of
the corpus: `plan` takes lengths from long to short, and a segment tree indexed by remaining capacity
finds the tightest open window for each. Windows of equal capacity form runs, and equal lengths are placed
in runs, so the plan is exact best-fit decreasing over the whole corpus in a bounded number of steps.
Each remainder then finds its place by its length and its rank among remainders of that length; ranks
are counts in buckets plus the buckets' offsets, so a length that a third of all documents have is no
task of its own.

Defined results: a null text is empty and has the closing id alone; rows that are equal in id and text
get the same pieces, each in a place of its own; an empty table gives no rows; other columns are
ignored, whatever their names; a text of any length is tokenised whole; of windows with equal room the one
opened last is filled first; a null doc_id is an id like any other.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stored, text_key
from tidewire.llm.sharding import with_slots

WINDOW = 2048
CLOSING_ID = 1
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: how a byte-level tokenizer's words are cut out of a text (the published pattern).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Of a tokenizer's file the ids of its pieces, as bytes, if merging by id is what it does: plain byte-level BPE whose merges stand in order of id."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(vocab) != 256 + len(merged):
        return None
    return {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items()}


class Encoder:
    """Texts to ids, as 32-bit little-endian bytes, each text for itself, so memory is bounded by the longest.

    The tokenizer's own library encodes a text with a special token's name in it, and every text of tokenizers that
    aren't plain byte-level BPE. Others are merged by the same ids in a faster library; where that gives up, which it
    does on endless white space, the tokenizer's own takes over.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.names = [t["content"] for t in spec.get("added_tokens") or ()]
        ranks = merge_ranks(spec)
        self.merge = tiktoken.Encoding("pieces", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def __call__(self, text: str) -> bytes:
        if self.merge and not any(n in text for n in self.names):
            try:
                return array("I", self.merge(text)).tobytes()
            except BaseException as e:  # what the library raises on a stack overflow is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return array("I", self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


def encoder(path: str) -> Encoder:
    """The Python worker's encoder: kept in a module of the worker's own, as this package travels with each task anew."""
    import sys
    import types

    kept = vars(sys.modules.setdefault("_tidewire_worker", types.ModuleType("_tidewire_worker"))).setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces(docs: DataFrame, window: int = WINDOW, closing_id: int = CLOSING_ID, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, fp (the text's fingerprint), doc_tokens, start, length, ids_crc32 and, if asked for, ids (32-bit little-endian) of each piece: full windows, then the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path or tokenizer_path()), np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                of, numbers, raws = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    raw = encode(text or "") + end
                    for s in range(0, len(raw), 4 * window):
                        piece = raw[s : s + 4 * window]
                        of.append(i)
                        numbers.append((len(raw) // 4, s // 4, len(piece) // 4, zlib.crc32(piece)))
                        if ids:
                            raws.append(piece)
                at = pa.array(of, pa.int64())
                columns = [part.column(0).take(at), part.column(1).take(at), *(pa.array(c, pa.int64()) for c in zip(*numbers, strict=True))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raws, pa.binary())] * ids, names)

    names = ["doc_id", "fp", "doc_tokens", "start", "length", "ids_crc32", *["ids"] * ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("fp"), "text").mapInArrow(cut, f"doc_id {kind}, fp long, doc_tokens long, start long, length long, ids_crc32 long{', ids binary' * ids}")


class CapacityTree:
    """The open windows by remaining capacity; `tightest(n)` is the least capacity >= n that has one, or 0."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]  # (first window, how many, tokens in it)

    def _mark(self, capacity: int) -> None:
        i = self.leaves + capacity
        self.some[i] = bool(self.runs[capacity])
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def push(self, capacity: int, run: tuple[int, int, int]) -> None:
        if capacity > 0:
            self.runs[capacity].append(run)
            self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, need: int) -> int:
        i = self.leaves + need
        if self.some[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return 0


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, first rank, first window, items per window, offset) of best-fit decreasing, and the number of windows.

    From its first rank on, a step puts `items per window` pieces of that length into each of consecutive
    windows, from the offset on. Of a run of windows with capacity c, a length n fills each with c // n
    pieces one after the other, as best fit does: the window just used is the tightest that still has room.
    """
    tree, steps, windows = CapacityTree(window), [], 0
    for n in sorted(histogram, reverse=True):
        rank, left = 0, histogram[n]
        while left:
            capacity = tree.tightest(n)
            if capacity:
                first, many, used = tree.pop(capacity)
            else:
                capacity, first, used = window, windows, 0
                many = -(-left // (window // n))
                windows += many
            per = capacity // n
            full = min(many, left // per)
            if full:
                steps.append((n, rank, first, per, used))
                rank, left = rank + full * per, left - full * per
                tree.push(capacity - per * n, (first, full, used + per * n))
            if full < many:
                rest = left if left < per else 0
                if rest:  # fewer than fill a window
                    steps.append((n, rank, first + full, rest, used))
                    tree.push(capacity - rest * n, (first + full, 1, used + rest * n))
                    rank, left = rank + rest, 0
                if many - full - bool(rest):
                    tree.push(capacity, (first + full + bool(rest), many - full - bool(rest), used))
    return steps, windows


def packed(docs: DataFrame, window: int = WINDOW, closing_id: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """Where each piece goes: doc_id, fp, doc_tokens, start, length, ids_crc32, sequence_id and offset.

    Texts are tokenised once; ids don't travel, their checksum does. `sequences` brings the ids together.
    """
    cut = stored(pieces(docs, window, closing_id, path, ids=False), "pieces")
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # no more rows than a window has tokens
    histogram = {r["length"]: r["n"] for r in counts}
    full = histogram.pop(window, 0)
    steps, windows = plan(histogram, window)
    ranked = with_slots(cut.withColumn("_u", F.xxhash64("doc_id", "fp", "start")), "length", [F.col("_u"), F.col("doc_id"), F.col("fp"), F.col("start")], F.col("_u"), full + sum(histogram.values()), "_place")
    firsts: dict[int, list[int]] = {}
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, rank, first, per, used in steps:
        firsts.setdefault(n, []).append(rank)
        by_length.setdefault(n, []).append((rank, first, per, used))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for n, rank in zip(batch.column("length").to_pylist(), batch.column("_place").to_pylist(), strict=True):
                if n == window:
                    sequence.append(windows + rank)
                    offset.append(0)
                    continue
                start, first, per, used = by_length[n][bisect.bisect_right(firsts[n], rank) - 1]
                sequence.append(first + (rank - start) // per)
                offset.append(used + (rank - start) % per * n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    names = ["doc_id", "fp", "doc_tokens", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.select(*names).dtypes)
    return ranked.select(*names, "_place").mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, window: int = WINDOW, closing_id: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """sequence_id and ids, binary, padded with the closing id to the window: what a trainer reads. Moves all ids once."""
    text = pieces(docs, window, closing_id, path).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("start").alias("_s"), "ids").dropDuplicates(["_d", "_f", "_s"])
    placed = packed(docs, window, closing_id, path)
    both = placed.join(text, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")) & (F.col("start") == F.col("_s")))
    whole = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.expr(f"repeat('{closing_id.to_bytes(4, 'little').hex()}', cast({window} - n as int))"))
    return whole.select("sequence_id", F.concat(joined, pad).alias("ids"), (F.lit(window) - F.col("n")).alias("n_padding"))


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
