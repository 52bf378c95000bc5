"""Ranked search, linear grouping and centroid clustering against brute force, with nulls, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidewire.llm import clustering, linear_grouping, packing, ranked_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ", term string, score double, tf long, rank int, piece string, length long, fp long, n long"
CLASH_VALUES = ("t", 0.5, 1, 2, "p", 3, 4, 5)


def ranked_by_hand(docs, items, k=10):
    """Every document scored for every item."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé9ß漢") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "\0", "É "]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)] + [(400, text(30_000)), (401, None), (402, ""), (403, "?! _"), (None, text(20)), (None, text(20))]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [docs[5]] * 3 + [(-(1 << 40), docs[5][1].upper())]
    items = [(i, text(rng.randint(1, 15)).title()) for i in range(30)] + [(30, docs[3][1]), (31, None), (32, "..."), (33, "zzz"), (34, docs[5][1]), (34, "a b"), (34, "a b"), (None, "abc a")]
    return docs, items


@pytest.mark.parametrize("postings", [ranked_search.SHARD_POSTINGS, 500])
def test_ranked_search(spark, library, monkeypatch, postings):
    docs, items = library
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 1000 if postings > 500 else 60)
    monkeypatch.setattr(ranked_search, "OPENED", 128 if postings > 500 else 3)
    df = spark.createDataFrame([(i, t, None, None, 0, *CLASH_VALUES) for i, t in docs], DOCS + CLASHES).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, term string")
    size = ranked_search.corpus(df)
    shards = ranked_search.index(df, size, postings)
    assert shards.count() >= (3 if postings > 500 else 20)
    got = ranked_search.searched(shards, asked, size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked_by_hand(docs, items), key=key)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.digest(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b", None, None, 0)], DOCS)
    assert ranked_search.digest(some, items.where("item_id > 1")).count() == 0
    assert [tuple(r) for r in ranked_search.digest(some, items).collect()] == ranked_by_hand([(1, "a b")], [(1, "a")])


def test_wavelet_tree_is_sorted_both_ways():
    """Of every term the ranges that lead to a document hold it once, and the first of a node's range has its greatest impact."""
    rng = random.Random(2)
    rows = [(i, n := rng.randint(1, 30), collections.Counter(rng.choice([b"a", b"b", b"c", b"dd", b"\xc3\xa9"]) for _ in range(n))) for i in range(77)]
    size = ranked_search.Corpus(77, sum(r[1] for r in rows))
    ids, n_docs, n_terms, *blobs = ranked_search._shard(list(rows), size)
    shard = ranked_search.Shard(ids, *blobs)
    assert (n_docs, n_terms, shard.levels) == (77, size.terms, 7)
    impact = {i: {t: 10**9 * tf // (1000 * tf + 8 * (10 + 90 * n * 77 // size.terms)) for t, tf in c.items()} for i, n, c in rows}
    for term, at in shard.term.items():
        nodes = [(0, 0, int(shard.starts[at]), int(shard.starts[at + 1]))]
        while nodes:
            level, span, lo, hi = nodes.pop()
            width = 1 << (shard.levels - level)
            inside = [impact[i][term] for i in range(span * width, min(77, (span + 1) * width)) if term in impact[i]]
            assert hi - lo == len(inside) and (not inside or shard.impacts[level * shard.n + lo] == max(inside))
            if inside and level < shard.levels:
                a, b = (int(shard.ones[level * (shard.n + 1) + x]) for x in (lo, hi))
                z = int(shard.zeros[level])
                nodes += [(level + 1, 2 * span, lo - a, hi - b), (level + 1, 2 * span + 1, z + a, z + b)]


def contents(histogram, steps):
    """Of each window the (offset, length) that a plan puts there; every piece is placed once."""
    windows, by_length = collections.defaultdict(list), collections.defaultdict(list)
    for s in sorted(steps):
        by_length[s[0]].append(s)
    for n, count in histogram.items():
        ranks = [s[1] for s in by_length[n]] + [count]
        assert ranks[0] == 0 and ranks == sorted(set(ranks))
        for (_, rank, first, per, used), end in zip(by_length[n], ranks[1:], strict=True):
            for r in range(end - rank):
                windows[first + r // per].append((used + r % per * n, n))
    return windows


@pytest.mark.parametrize("window", [12, 64, 200])
def test_linear_grouping_plan(window):
    for seed in range(25):
        rng = random.Random(seed)
        kinds = [range(1, window), range(window // 3, window // 2 + 1), [window // 2, window // 2 + 1, 3], [1, 2], [window - 1]][seed % 5]
        lengths = collections.Counter(rng.choice(list(kinds)) for _ in range(rng.choice([0, 1, 7, 300, 2000])))
        histogram = {n: c for n, c in lengths.items() if 0 < n < window}
        groups = rng.choice([3, 20, 300])
        steps, windows = linear_grouping.plan(histogram, window, groups=groups)
        held = contents(histogram, steps)
        assert sorted(held) == list(range(windows))
        for places in held.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= window
        least = -(-sum(n * c for n, c in histogram.items()) // window)
        best_fit = packing.plan(histogram, window)[1]
        assert least <= windows <= best_fit * {3: 1.5, 20: 1.1, 300: 1.02}[groups] + 3


def test_linear_grouping_finds_configurations():
    """Three sizes that best fit puts together badly: 6 + 6 + 8 fill a window of 20, best-fit decreasing puts 8 + 8 first."""
    assert packing.plan({6: 200, 8: 100}, 20)[1] > 100
    assert linear_grouping.plan({6: 200, 8: 100}, 20, 4, 3)[1] == 100
    assert linear_grouping.plan({34: 3000, 33: 6000}, 100, 4, 3)[1] == 3000
    assert linear_grouping.classes({9: 4, 7: 5, 3: 50}, 5, 3) == [(9, 6), (7, 3)]


def test_linear_grouping(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["the", "moon", "über", "x1", "\n", "漢字"]) for _ in range(n))
    texts = [None, "", " ", *(text(rng.randint(1, 3000)) for _ in range(60)), text(40_000), "a" * 5000, "say <|endoftext|> so"]
    rows = [(i, t, None, None, 0, *CLASH_VALUES) for i, t in enumerate(texts)] + [(None, texts[5], None, None, 0, *CLASH_VALUES)] * 3
    docs = spark.createDataFrame(rows + rows[:20], DOCS + CLASHES)
    got = linear_grouping.digest(docs).collect()
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in [*enumerate(texts), (None, texts[5])]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        times = 3 if i is None else 2 if i < 20 else 1
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        assert collections.Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == {
            (k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())): times for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))
        }
    for places in by_window.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    whole = linear_grouping.sequences(docs).collect()
    assert len(whole) == len({r["sequence_id"] for r in whole}) == len(by_window)
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in got) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert linear_grouping.digest(docs.limit(0)).count() == 0


def clustered_by_hand(rows, clusters, rounds, dim=64):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        mine = collections.defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        centroids = [[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if mine[k] else c for k, c in enumerate(centroids)]
    inertia = collections.Counter()
    for _, v in kept:
        d, k = near(v)
        inertia[k] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), names[k]) for i, v in kept for d, k in [near(v)]), key=str)


def test_clustering(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 64))
    rows = [(i, (centres[i % 6] + 0.2 * rng.standard_normal(64)).astype("float32").tolist()) for i in range(150)]
    rows += [(200 + i, [float(i % 2)] * 64) for i in range(30)] + [(300, [-1.0] * 64)] * 3 + [(300, [1.0] * 64), (None, [0.5] * 64), (None, [0.5] * 64)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None, *[1.0] * 63]), (405, [math.nan, *[1.0] * 63]), (406, [math.inf, *[1.0] * 63]), (407, [-math.inf, *[1.0] * 63])]
    df = spark.createDataFrame([(i, v, None, 1, "c", 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, cluster int, v string, distance double")
    got = sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in clustering.digest(df.repartition(5)).collect()), key=str)
    assert got == clustered_by_hand(rows, 16, 3)
    few = df.where("vec_id < 5")
    assert len(clustering.digest(few).collect()) == 5 and clustering.digest(df.limit(0)).count() == 0
    assert clustering.digest(df.where("vec_id >= 400")).count() == 0


def test_screening_changes_nothing():
    """Against all distances; on vectors of different lengths most centroids are left out by the bound alone."""
    rng = np.random.default_rng(9)
    for spread in (0, 1, 3, 100_000):
        x = rng.integers(-40, 40, (500, 64)) * rng.integers(1, 2 + spread, (500, 1))
        c = np.concatenate([x[:10], x[:3], rng.integers(-40, 40, (7, 64)) * rng.integers(1, 2 + spread, (7, 1))])
        norms = (x.reshape(500, 16, 4) ** 2).sum(2)
        which, least, exact = clustering.nearest(x, norms, c)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (which == d.argmin(1)).all() and (least == d.min(1)).all()
        assert exact <= d.size and (spread < 100_000 or exact < 0.8 * d.size)


def test_large_components_raise(spark):
    df = spark.createDataFrame([(1, [2.0**21] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="in magnitude"):
        clustering.digest(df).collect()
