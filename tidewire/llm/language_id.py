"""Language identification by error-correcting output codes.

Each language has a codeword of bits, and each bit has a binary classifier over hashed byte n-grams: it
tells the languages whose codeword has a 1 there from the others. A document's margin for a bit is the
mean over its n-grams of the log odds that the counts of both sides give. Decoding is loss-weighted: the
codeword with the least sum of weighted losses of its bits wins, a bit's weight being how well its
classifier separates the sides. The distance to the second best tells how ambiguous the answer is.

All labelled rows count, and every label is learned: each task counts n-grams per language and writes them
in slices of the buckets; a slice's counts are summed language by language and go into the two sides of every
bit. What reaches the driver is a number per language and buckets x bits of log odds.

Defined results: a null text, or one without a letter, is `und` with score 0; a null label is not learned
from; without any label every answer is `und`; repeated rows count twice and are answered alike; an
empty table gives no rows; other columns are ignored, whatever their names; a text of any length is read
whole; of languages that tie the first by code point is the answer; a null doc_id is never held out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stored

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Beyond so many languages the codes are random rather than exhaustive.
EXHAUSTIVE = 6
RANDOM_BITS = 40
#: Counts are summed in so many slices of the buckets; a task holds those of so many languages before it writes them.
SLICES = 16
HELD = 256
#: How fast a bit's logistic loss falls with its margin (a mean of log odds, mostly below 1), and the distance of losses under which an answer is ambiguous.
STEEPNESS = 10.0
AMBIGUOUS = 0.2


def features(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """How often each bucket of hashed n-grams of the lower-cased text's bytes occurs. Long texts are counted in blocks that overlap."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    total = np.zeros(buckets, np.int64)
    block, reach = 1 << 18, max(orders) - 1
    for lo in range(0, len(raw), block):
        x = raw[lo : lo + block + reach].astype(np.uint32)
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(orders) + 1):
            h = h[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :]
            own = h[: min(block, len(h))]
            if n in orders and len(own):
                mixed = (own + np.uint32(n)) * np.uint32(2654435761)
                total += np.bincount((mixed >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64), minlength=buckets)
    return total


def codewords(n: int) -> np.ndarray:
    """n rows of bits. Few languages: every split in two; many: the best of seeded random codes by least distance of rows."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        return np.array([[1 if i == 0 else (split >> (i - 1)) & 1 for split in range(2 ** (n - 1) - 1)] for i in range(n)], np.int8)
    bits = max(RANDOM_BITS, 10 * math.ceil(math.log2(n) - 2))
    rng, best = np.random.default_rng(5), None
    while best is None or best[0] == 0:
        for _ in range(max(1, min(50, 50_000_000 // (n * n)))):
            code = rng.integers(0, 2, (n, bits), dtype=np.int8)
            if (code.min(0) == code.max(0)).any():
                continue
            least = least_distance(code)
            if best is None or least > best[0]:
                best = (least, code)
    return best[1]


def least_distance(code: np.ndarray) -> int:
    """In how many bits the two nearest of the rows differ."""
    signs = 2 * code.astype(np.float32) - 1
    least = code.shape[1]
    for lo in range(0, len(code), 1024):
        same = signs[lo : lo + 1024] @ signs.T
        same[np.arange(len(same)), np.arange(lo, lo + len(same))] = -code.shape[1]
        least = min(least, int(code.shape[1] - same.max()) // 2)
    return least


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds
    trust: np.ndarray  # weight of each bit's loss
    ambiguous_below: float = AMBIGUOUS

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / max(1, counts.sum())

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, and whether the second best is near."""
        signs = 2.0 * self.code - 1.0
        loss = (np.log1p(np.exp(-STEEPNESS * signs * margins)) * self.trust).sum(1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        belief = np.exp(loss.min() - loss)
        score = float(belief[order[0]] / belief.sum())
        gap = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else 1.0
        return self.languages[order[0]], score, gap < self.ambiguous_below


def counted(labelled: DataFrame) -> DataFrame:
    """lang, slice, and the n-gram counts (64-bit, deflated) and their total of a part of its texts in that slice of the buckets."""
    width = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                parts = total.reshape(SLICES, width)
                packed = [zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array(parts.sum(1), pa.int64()), pa.array(packed, pa.binary())], ["lang", "slice", "total", "counts"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums and len(sums) == HELD:
                    yield from told()
                f = features(text)
                sums[lang] = sums[lang] + f if lang in sums else f
        yield from told()

    return labelled.select("lang", "text").mapInArrow(count, "lang string, slice int, total long, counts binary")


def trained(labelled: DataFrame) -> Model | None:
    """The model that the rows with text and lang give, of every lang; None without any."""
    parts = stored(counted(labelled.where("text IS NOT NULL AND lang IS NOT NULL")), "language-counts")
    totals = {r["lang"]: r["total"] for r in parts.groupBy("lang").agg(F.sum("total").alias("total")).collect()}  # a number per language
    names = sorted(totals)
    if not names:
        return None
    code = codewords(len(names))
    sent = parts.sparkSession.sparkContext.broadcast(({name: i for i, name in enumerate(names)}, np.array([totals[n] for n in names]), code))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by slice and lang."""
        at, total, code = sent.value
        for slice_, weights, trust in weighted(batches, at, total, code):
            yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([trust.tobytes()], pa.binary())], ["slice", "weights", "trust"])

    by_slice = parts.select("slice", "lang", "counts").repartition(SLICES, "slice").sortWithinPartitions("slice", "lang")
    rows = sorted(by_slice.mapInArrow(weigh, "slice int, weights binary, trust binary").collect(), key=lambda r: r["slice"])  # buckets x bits
    weights = np.concatenate([np.frombuffer(r["weights"]).reshape(-1, code.shape[1]) for r in rows])
    trust = np.maximum(1e-3, np.sum([np.frombuffer(r["trust"]) for r in rows], axis=0))
    trust[code.min(0) == code.max(0)] = 1.0
    return Model(names, code, weights, trust)


def weighted(batches: Iterator[pa.RecordBatch], at: dict[str, int], total: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice its buckets' log odds of each bit and its share of each bit's divergence, every language of a side having the same say whatever its share of the rows."""
    width, bits = BUCKETS // SLICES, code.shape[1]
    ones = code.sum(0)
    split = (ones > 0) & (ones < len(code))

    def languages() -> Iterator[tuple[int, str, np.ndarray]]:
        key, held = None, None
        for batch in batches:
            for slice_, lang, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = np.frombuffer(zlib.decompress(raw), "<i8")
                if key == (slice_, lang):
                    held = held + part
                    continue
                if key:
                    yield *key, held
                key, held = (slice_, lang), part
        if key:
            yield *key, held

    def odds(sides: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = sides[0] / np.maximum(1, ones), sides[1] / np.maximum(1, len(code) - ones)
        weights = np.zeros((width, bits))
        weights[:, split] = np.where(seen[:, None], np.log(p[:, split]) - np.log(q[:, split]), 0.0)
        return weights, ((p - q) * weights).sum(0)  # divergence of the two sides

    now, sides, seen = None, None, None
    for slice_, lang, counts in languages():
        if slice_ != now:
            if now is not None:
                yield now, *odds(sides, seen)
            now, sides, seen = slice_, np.zeros((2, width, bits)), np.zeros(width, bool)
        i = at[lang]
        rate = (counts + 0.5) / (total[i] + 0.5 * BUCKETS)
        sides[0][:, code[i] == 1] += rate[:, None]
        sides[1][:, code[i] == 0] += rate[:, None]
        seen |= counts > 0
    if now is not None:
        yield now, *odds(sides, seen)


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous, from nothing but the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # buckets x bits, whatever the corpus

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts):
        import pandas as pd

        m, out = sent.value and Model(**sent.value), []
        for t in texts:
            if m is None or t is None or not has_letter(t):
                out.append(("und", 0.0, True))
            else:
                out.append(m.decode(m.margins(features(t))))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn("_lang", predict(F.col(text_col))).select(*docs.columns, "_lang.*")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that the query doesn't learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    model = trained(docs.where(~held_out()).select("text", "lang"))
    return identified(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
