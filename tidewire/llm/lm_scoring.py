"""Scoring documents with a Katz backoff model of n-grams up to ORDER words.

log10 P(text) is summed over the words and one end token, with the end token also the history of the
first word. Evaluation is recursive, from single words up: an n-gram seen in training has its Good-Turing
discounted relative frequency; any other token backs off to alpha(history) times its probability by the shorter
history, and single words are discounted in the same way and leave the rest to unknown ones. alpha is the
history's leftover mass over what the shorter history leaves to the words not seen behind it, both summed exactly,
so that every history's probabilities add up to 1 over the vocabulary and the unknown word. A word without that many
before it in its text has the shorter history alone.

Texts become blocks of about BLOCK tokens: a sorted vocabulary of 64-bit word hashes and one code per
token. Count tables are partitioned by hash: a block sends each partition one packed slice of what it
has, the partition adds the slices up and answers each block in the order it asked. So a token is never
a row, a shuffle has at most one entry per block and distinct item, and no table is broadcast. Histories
with very many tokens are split over several partitions by successor, and only their sums (at most
HOT_MOST rows) pass through the driver.

Defined results: a null or empty text is the end token alone; a null doc_id is learned from; rows that
are equal in every way are all counted and scored alike; without training text every probability is
that of an unknown word, 1; an empty table gives no rows; other columns are ignored, whatever their names;
a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stored

#: Tokens of a block, and entries of a partition of a table, about.
BLOCK = 1_000_000
PART = 1_000_000
#: Words of the longest n-grams.
ORDER = 2
#: Good-Turing discounts counts up to this.
K = 5
#: A history is split if it has more tokens than this, and more than this share of all.
HOT, HOT_MOST = 1_000_000, 100_000
END = 0x517CC1B727220A95


def pack(a: np.ndarray) -> bytes:
    """An array of numbers as bytes: item size, length, and its bytes by significance, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return np.array([a.itemsize, len(a)], "<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes, kind) -> np.ndarray:
    size, n = np.frombuffer(raw, "<i8", 2)
    planes = np.frombuffer(pa.decompress(raw[16:], int(size * n), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind).copy()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each 64-bit hash: ranges of equal width, in order."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class _Vocabulary(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of docs (id, held, text) as blocks: ids, held, lengths, codes by token into the sorted vocabulary, and training counts by word."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, held, lengths, codes, vocabulary, tokens = [], [], [], [], _Vocabulary(), 0

        def done() -> pa.RecordBatch:
            words = list(vocabulary)
            hashes = np.array([END if w is None else xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
            n = np.concatenate([np.asarray(c, np.int32) for c in codes])
            trained = np.repeat(~np.array(held, bool), lengths)
            # equal hashes are one word
            uniq, of = np.unique(hashes, return_inverse=True)
            n = of[n].astype(np.int32)
            counts = np.bincount(n[trained], minlength=len(uniq)).astype(np.uint32)
            often = np.argsort(-np.bincount(n, minlength=len(uniq)), kind="stable").astype(np.int32)
            rank = np.empty(len(uniq), np.int32)
            rank[often] = np.arange(len(uniq), dtype=np.int32)  # frequent words get small numbers, which pack well
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([held]), *(pa.array([pack(x)], pa.binary()) for x in (np.array(lengths, np.int32), rank[n], often)), pa.array([pack_sorted(uniq)], pa.binary()), pa.array([pack(counts)], pa.binary()), pa.array([len(uniq)], pa.int64()), pa.array([len(n)], pa.int64())],
                ["block", "ids", "held", "lengths", "codes", "often", "vocabulary", "counts", "n_words", "n_tokens"],
            )

        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for i, h, text in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = (text or "").encode().lower().split()
                ids.append(i)
                held.append(h)
                lengths.append(len(w) + 1)
                w.append(None)  # the end
                codes.append(np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)))
                tokens += len(w)
                if tokens >= BLOCK:
                    yield done()
                    number += 1
                    ids, held, lengths, codes, vocabulary, tokens = [], [], [], [], _Vocabulary(), 0
        if ids:
            yield done()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(make, f"block long, ids array<{kind}>, held array<boolean>, lengths binary, codes binary, often binary, vocabulary binary, counts binary, n_words long, n_tokens long")


def unigrams(table: DataFrame, parts: int) -> DataFrame:
    """For each block and partition the sorted words' numbers (within the partition) and counts; with block -1 the partition's table."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v, c in zip(*(batch.column(x).to_pylist() for x in ("block", "vocabulary", "counts")), strict=True):
                h, n = unpack_sorted(v, np.uint64), unpack(c, np.uint32)
                cuts = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([block] * len(some), pa.int64()), pa.array([pack_sorted(h[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()), pa.array([pack(n[cuts[p] : cuts[p + 1]]) for p in some], pa.binary())], ["part", "block", "h", "n"])

    def add(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        order = sorted(range(group.num_rows), key=lambda i: group.column("block")[i].as_py())
        asked = [unpack_sorted(group.column("h")[i].as_py(), np.uint64) for i in order]
        given = np.concatenate([unpack(group.column("n")[i].as_py(), np.uint32) for i in order])
        uniq, of = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(of, given, len(uniq)).astype(np.int64)
        rows = [(-1, pack_sorted(uniq), pack(total))]
        ends = np.cumsum([len(a) for a in asked])[:-1]
        rows += [(group.column("block")[i].as_py(), pack_sorted(x.astype(np.uint32)), pack(total[x])) for i, x in zip(order, np.split(of, ends), strict=True)]
        known = total[total > 0]
        stats = np.bincount(np.minimum(known, K + 2), minlength=K + 3)[1 : K + 2].tolist()
        return pa.table({"part": pa.array([part] * len(rows), pa.int64()), "block": pa.array([r[0] for r in rows], pa.int64()), "numbers": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary()), "size": pa.array([len(uniq)] * len(rows), pa.int64()), "known": pa.array([len(known)] * len(rows), pa.int64()), "tokens": pa.array([int(total.sum())] * len(rows), pa.int64()), "stats": pa.array([stats] * len(rows), pa.list_(pa.int64()))})

    sliced = table.select("block", "vocabulary", "counts").mapInArrow(slices, "part long, block long, h binary, n binary")
    return sliced.groupBy("part").applyInArrow(add, "part long, block long, numbers binary, counts binary, size long, known long, tokens long, stats array<long>")


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for counts r = 0 to K from the numbers of items with counts 1 to K + 1 (Good-Turing, cut at K); beyond, 1.

    Where the numbers don't allow it (too little or odd data), an absolute discount takes its place.
    """
    d = np.ones(K + 1)
    if min(n) > 0:
        common = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            d[r] = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common != 1 else -1
        if (d[1:] > 0).all() and (d[1:] < 1).all():
            return d
    off = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5))
    return np.array([1.0, *((r - off) / r for r in range(1, K + 1))])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return counts * np.where(counts <= K, d[np.minimum(counts, K)], 1.0)


class Unigrams:
    """Discounted unigram probabilities, the unknown word's among them."""

    def __init__(self, tokens: int, n: list[int]):
        self.tokens, self.n, self.d = tokens, n, discounts(n)
        lost = sum(n[r - 1] * r * (1 - self.d[r]) for r in range(1, K + 1))
        self.scale = 1.0 if lost > 0 else tokens / (tokens + 0.5)  # nothing was discounted: half a token for the unknown
        self.unknown = lost / tokens if lost > 0 else 0.5 / (tokens + 0.5) if tokens else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, discounted(counts, self.d) * self.scale / self.tokens, self.unknown)


def _words(row: dict, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (over all partitions) and counts of a block's sorted vocabulary."""
    answers = sorted(row["words"], key=lambda x: x["part"])
    ids = np.concatenate([unpack_sorted(a["numbers"], np.uint32).astype(np.int64) + offsets[a["part"]] for a in answers])
    return ids, np.concatenate([unpack(a["counts"], np.int64) for a in answers])


class Level:
    """What a table of one order has told the driver: discounts, split histories' sums, and where each partition's numbers begin."""

    def __init__(self, parts: int, told: list[dict]):
        self.parts = parts
        self.d = discounts([sum(r["stats"][i] for r in told) for i in range(K + 1)])
        self.split: dict[int, np.ndarray] = {}
        for r in told:
            for h, s in zip(unpack(bytes(r["counts"]), np.int64).tolist(), unpack(bytes(r["sums"]), np.float64).reshape(-1, K + 2), strict=True):
                self.split[h] = self.split[h] + s if h in self.split else s
        sizes = np.zeros(parts, np.int64)
        for r in told:
            sizes[r["part"]] = r["size"]
        self.offsets = np.cumsum(sizes) - sizes


def _pairs(h: np.ndarray, w: np.ndarray, hid: np.ndarray, hcount: np.ndarray, wid: np.ndarray, trained: np.ndarray, parts: int, hot: int):
    """A block's distinct n-grams in order of partition, history and last word, from each token's history (-1: none) and word, as places in hid and wid.

    Places of history and word, partition, of each token its n-gram (-1: none), and training counts.
    """
    use = np.flatnonzero(h >= 0)
    key, of = np.unique(h[use] * len(wid) + w[use], return_inverse=True)
    hp, wp = key // len(wid), key % len(wid)
    split = 1 + hcount[hp] // hot
    sub = (mixed(wid[wp].astype(np.uint64)) % split.astype(np.uint64)).astype(np.uint64)
    part = part_of(mixed(hid[hp].astype(np.uint64) + (sub << np.uint64(48)) + np.uint64(1)), parts)
    order = np.argsort(part, kind="stable")  # key order, that is history and word, stays within
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = np.full(len(h), -1)
    at[use] = place[of]
    n = np.bincount(at[(at >= 0) & trained], minlength=len(order)).astype(np.uint32)
    return hp[order], wp[order], part[order], at, n


class Scorer:
    """The model as far as it is counted: evaluates a block's tokens, order by order."""

    def __init__(self, offsets: np.ndarray, tokens: int, ns: list[int], hot: int, levels: list[Level]):
        self.offsets, self.uni, self.hot, self.levels = offsets, Unigrams(tokens, ns), hot, levels

    def block(self, row: dict) -> dict:
        """Words and histories of a block's tokens before any order above 1."""
        ids, counts = _words(row, self.offsets)
        often, codes, lengths = unpack(row["often"], np.int32), unpack(row["codes"], np.int32), unpack(row["lengths"], np.int32)
        w = often[codes].astype(np.int64)
        ends = np.cumsum(lengths) - 1
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[0] = w[ends[0]]  # the end is before the first word
        first = np.zeros(len(w), bool)
        first[np.r_[0, ends[:-1] + 1]] = True
        trained = np.repeat(~np.array(row["held"], bool), lengths)
        return {"wid": ids, "wcount": counts, "w": w, "h": h, "hid": ids, "hcount": counts, "first": first, "trained": trained, "lengths": lengths, "p": self.uni(counts)[w]}

    def next(self, b: dict, level: Level, answers: list[dict]) -> dict:
        """The block after one order more: the tokens' probabilities, and their n-grams as histories of the words behind them."""
        hp, _, part, at, _ = _pairs(b["h"], b["w"], b["hid"], b["hcount"], b["wid"], b["trained"], level.parts, self.hot)
        answers = sorted(answers, key=lambda x: x["part"])
        seen = np.concatenate([unpack(a["counts"], np.int64) for a in answers]) if answers else np.zeros(0, np.int64)
        sums = np.concatenate([np.c_[x.reshape(K + 2, -1)[: K + 1].T.astype(float), x.reshape(K + 2, -1)[K + 1].view(np.float64)] for a in answers for x in [unpack(a["sums"], np.int64)]]) if answers else np.zeros((0, K + 2))
        if not len(hp):
            return b | {"h": np.full(len(at), -1), "hid": np.zeros(0, np.int64), "hcount": np.zeros(0, np.int64)}
        group = np.cumsum(np.r_[True, (hp[1:] != hp[:-1]) | (part[1:] != part[:-1])]) - 1  # of each n-gram its history's place in sums
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ch = b["hcount"][hp[first]]
        for g in np.flatnonzero(ch >= self.hot):
            sums[g] = level.split[int(b["hid"][hp[first[g]]])]
        mass = sums[:, :K] @ (level.d[1:] * np.arange(1, K + 1)) + sums[:, K]
        had = np.maximum(ch, 1).astype(float)
        none = (ch > 0) & (had - mass < 1e-9 * had)  # nothing was discounted: half a token for the rest
        scale = np.where(none, had / (had + 0.5), 1.0)
        alpha = np.where(ch > 0, (1 - mass / had * scale) / (1 - sums[:, K + 1]), 1.0)
        direct = discounted(seen, level.d) * scale[group] / had[group]
        use = at >= 0
        p = b["p"].copy()
        p[use] = np.where(seen[at[use]] > 0, direct[at[use]], alpha[group[at[use]]] * p[use])
        history = np.r_[-1, at[:-1]]
        history[b["first"]] = -1
        numbers = np.concatenate([unpack_sorted(a["numbers"], np.uint32).astype(np.int64) + level.offsets[a["part"]] for a in answers]) if answers[0]["numbers"] else np.zeros(len(seen), np.int64)
        return b | {"p": p, "h": history, "hid": numbers, "hcount": seen}

    def __call__(self, row: dict) -> dict:
        b = self.block(row)
        for m, level in enumerate(self.levels, 2):
            b = self.next(b, level, row[f"order{m}"])
        return b


def slices_of(joined: DataFrame, scorer: Scorer, parts: int) -> DataFrame:
    """part, block and what the block has there of the next order: histories with their counts, last words with their probabilities so far, training counts."""
    plain = not scorer.levels  # the words' counts tell their probabilities

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = scorer(row)
                hp, wp, part, at, n = _pairs(b["h"], b["w"], b["hid"], b["hcount"], b["wid"], b["trained"], parts, scorer.hot)
                low = b["wcount"][wp] if plain else np.zeros(len(hp))
                if not plain:
                    low[at[at >= 0]] = b["p"][at >= 0]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cuts))
                out: list[list[bytes]] = [[] for _ in range(6)]
                for p in some:
                    lo, hi = cuts[p], cuts[p + 1]
                    first = np.flatnonzero(np.r_[True, hp[lo + 1 : hi] != hp[lo : hi - 1]])
                    own = hp[lo:hi][first]
                    for column, x in zip(out, (pack_sorted(b["hid"][own]), pack(b["hcount"][own]), pack(np.diff(np.r_[first, hi - lo]).astype(np.uint32)), pack(b["wid"][wp[lo:hi]]), pack(low[lo:hi]), pack(n[lo:hi])), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([row["block"]] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in out)], ["part", "block", "h", "ch", "size", "w", "low", "n"])

    return joined.mapInArrow(make, "part long, block long, h binary, ch binary, size binary, w binary, low binary, n binary")


def counted(slices: DataFrame, scorer: Scorer, last: bool) -> DataFrame:
    """For each block and partition the n-grams' counts (and, unless the order is the last, numbers) and of each history its last words' sums, in the order asked; with block -1 the partition's sums of split histories and counts of counts."""
    tokens, ns, hot, plain = scorer.uni.tokens, scorer.uni.n, scorer.hot, not scorer.levels

    def add(group: pa.Table) -> pa.Table:
        part, order = group.column("part")[0].as_py(), sorted(range(group.num_rows), key=lambda i: group.column("block")[i].as_py())
        get = lambda c, i: group.column(c)[i].as_py()
        hs = [unpack_sorted(get("h", i), np.int64) for i in order]
        sizes = [unpack(get("size", i), np.uint32).astype(np.int64) for i in order]
        h = np.concatenate([np.repeat(a, b) for a, b in zip(hs, sizes, strict=True)])
        w = np.concatenate([unpack(get("w", i), np.int64) for i in order])
        low = np.concatenate([unpack(get("low", i), np.int64 if plain else np.float64) for i in order])
        n = np.concatenate([unpack(get("n", i), np.uint32) for i in order])
        allh, of_h = np.unique(np.concatenate(hs), return_inverse=True)
        dense = np.searchsorted(allh, h)
        sort = np.lexsort((w, dense))
        ds, ws = dense[sort], w[sort]
        new = np.r_[True, (ds[1:] != ds[:-1]) | (ws[1:] != ws[:-1])]
        which = np.cumsum(new) - 1
        of = np.empty(len(sort), np.int64)
        of[sort] = which
        total = np.bincount(of, n, int(which[-1]) + 1).astype(np.int64)
        hu, lowu = ds[new], low[sort][new]
        seen = total > 0
        sums = np.zeros((len(allh), K + 2))
        small = seen & (total <= K)
        np.add.at(sums, (hu[small], total[small] - 1), 1)  # last words with counts 1 to K
        sums[:, K] = np.bincount(hu[seen & ~small], total[seen & ~small], len(allh))
        sums[:, K + 1] = np.bincount(hu[seen], Unigrams(tokens, ns)(lowu[seen]) if plain else lowu[seen], len(allh))
        stats = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
        ch = np.concatenate([unpack(get("ch", i), np.int64) for i in order])
        is_hot = np.unique(of_h[ch >= hot])
        rows = [(-1, pack(allh[is_hot]), pack(sums[is_hot].reshape(-1)), None)]
        a = np.cumsum([0, *map(sum, sizes)])
        b = np.cumsum([0, *map(len, hs)])
        for k, i in enumerate(order):
            mine, own = sums[of_h[b[k] : b[k + 1]]], of[a[k] : a[k + 1]]
            rows.append((get("block", i), pack(total[own]), pack(np.concatenate([mine[:, : K + 1].astype(np.int64).T.reshape(-1), mine[:, K + 1].view(np.int64)])), None if last else pack_sorted(own.astype(np.uint32))))
        m = len(rows)
        return pa.table({"part": pa.array([part] * m, pa.int64()), "block": pa.array([r[0] for r in rows], pa.int64()), "counts": pa.array([r[1] for r in rows], pa.binary()), "sums": pa.array([r[2] for r in rows], pa.binary()), "numbers": pa.array([r[3] for r in rows], pa.binary()), "size": pa.array([len(total)] * m, pa.int64()), "stats": pa.array([stats] * m, pa.list_(pa.int64()))})

    return slices.groupBy("part").applyInArrow(add, "part long, block long, counts binary, sums binary, numbers binary, size long, stats array<long>")


def scored(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, held, n_tokens, n_known, train_tokens, base_score and score of every row; learned from the rows that are not held."""
    table = stored(blocks(docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))), "lm-blocks")
    size = table.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    parts = max(1, -(-(size["w"] or 0) // PART))
    words = stored(unigrams(table, parts), "lm-unigrams")
    told = words.where("block = -1").select("part", "size", "known", "tokens", "stats").collect()  # a row per partition
    tokens, known = sum(r["tokens"] for r in told), sum(r["known"] for r in told)
    ns = [sum(r["stats"][i] for r in told) for i in range(K + 1)]
    sizes = np.zeros(parts, np.int64)
    for r in told:
        sizes[r["part"]] = r["size"]
    scorer = Scorer(np.cumsum(sizes) - sizes, tokens, ns, max(HOT, tokens // HOT_MOST), [])
    of_block = words.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "numbers", "counts")).alias("words"))
    joined = table.select("block", "ids", "held", "lengths", "codes", "often").join(of_block, "block")
    for m in range(2, order + 1):
        # distinct n-grams: three for each distinct word of a block, and never more than tokens
        n_parts = max(1, -(-min(3 ** (m - 1) * (size["w"] or 0), size["t"] or 0) // PART))
        grams = stored(counted(slices_of(joined.drop("ids"), scorer, n_parts), scorer, m == order), f"lm-order{m}")
        told = grams.where("block = -1").select("part", "stats", "counts", "sums", "size").collect()  # a row per partition, with its split histories
        scorer = Scorer(scorer.offsets, tokens, ns, scorer.hot, [*scorer.levels, Level(n_parts, [r.asDict() for r in told])])
        answers = grams.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "counts", "sums", "numbers")).alias(f"order{m}"))
        joined = joined.join(answers, "block", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.drop_columns(["ids"]).to_pylist()[0]
                b = scorer({k: v if v is not None else [] for k, v in row.items()})
                counts, lengths = b["wcount"][b["w"]], b["lengths"]
                starts = np.cumsum(lengths) - lengths
                add = lambda x, starts=starts: pa.array(np.add.reduceat(x, starts))
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("held").flatten(), pa.array(lengths.astype(np.int64)), add((counts > 0).astype(np.int64)), pa.array(np.full(len(lengths), tokens)), add(np.log10((counts + 1) / (tokens + known + 1))), add(np.log10(b["p"]))], ["id", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    # a block's answers are a large row, so they go to Python one by one
    return stored(joined.mapInArrow(score, f"id {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that the query doesn't learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    return scored(docs, held_out()).withColumnsRenamed({"id": "doc_id", "held": "held_out"})
