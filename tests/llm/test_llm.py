"""Operators of the training-data subpackage against brute force on small fixtures, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from tidewire.llm import components, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, sharding, suffix_dedup



def spark_hash(*values):
    """Spark's xxhash64 of a row, by the library: int for 32 bits, np.int64 for 64, str, bool; None changes nothing."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", int(v)) if isinstance(v, np.int64) else struct.pack("<i", int(v))
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, extra="", values=()):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), *values) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + extra)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    return lambda n, seed: [random.Random(seed * 1000 + i).choice(vocabulary) for i in range(n)]


@pytest.fixture(scope="module")
def odd(words):
    """Null, empty, blank, short, long, repeated and near texts."""
    base = words(120, 1)
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (5, 60, 119)]
    lines = ["\n".join(" ".join(words(6, 50 + k)) for k in range(j, j + 8)) for j in (0, 2, 4)]
    return [None, "", " \n\t", "one", "Two words", " ".join(base), " ".join(base), *near, *lines, lines[0], "a b c " * 50, " ".join(words(5000, 9)), "é ß ł\n\n\nx y", "WORDS! " * 60]


def empty(spark):
    return spark.createDataFrame([], DOCS)


CLASHES = ", n_words long, failed long, size long, class long, fp long, _row long, later string, shard int, component long, length long, count long"
CLASH_VALUES = (1, 2, 3, 4, 5, 6, "x", 7, 8, 9, 10)


def test_quality(spark, odd):
    docs = make(spark, odd, CLASHES, CLASH_VALUES)
    got = {r["doc_id"]: r for r in quality_rules.digest(docs).collect()}
    for i, t in enumerate(odd):
        w = (t or "").encode().split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(w), len(covered))
        assert got[i]["word_chars"] == sum(len(x.decode()) for x in w)
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.digest(empty(spark)).count() == 0
    ledger = quality_rules.ledger(docs).collect()
    mask = quality_rules.PROSE_POLICY.mask
    for r in quality_rules.ablations(quality_rules.ledger(docs)).collect():
        bit = quality_rules.BIT[r["rule"]]
        assert r["n_only_this"] == sum(x["failed"] & mask == bit for x in ledger)
        assert r["n_rejected_without"] == sum(x["failed"] & mask & ~bit != 0 for x in ledger)


def test_line_dedup(spark, odd):
    docs = make(spark, odd, CLASHES, CLASH_VALUES)
    got = {r["doc_id"]: r for r in line_dedup.deduped(docs).collect()}
    seen, removed = {}, collections.defaultdict(set)
    for i, t in enumerate(odd):
        lines = (t or "").split("\n")
        for j in range(len(lines) - 2):
            win = tuple(lines[j : j + 3])
            if "".join(win).encode().split():
                if win in seen:
                    removed[i] |= {j, j + 1, j + 2}
                seen.setdefault(win, (i, j))
    for i, t in enumerate(odd):
        expected = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in removed[i])
        assert got[i]["text"] == expected and got[i]["n_removed"] == len(removed[i])
    assert line_dedup.cleaned(docs).columns == docs.columns
    twice = docs.union(docs)
    assert sorted(map(str, line_dedup.deduped(twice).collect())) == sorted(map(str, [*got.values(), *got.values()]))
    assert line_dedup.deduped(empty(spark)).count() == 0


def test_sharding(spark, odd):
    docs = make(spark, odd * 20, CLASHES, CLASH_VALUES).union(spark.createDataFrame([(None, None, None, None, None, *CLASH_VALUES)] * 3, DOCS + CLASHES))
    rows = sharding.digest(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert len(rows) == 20 * len(odd) + 3 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sum(r["size"] == 16 and r["text_crc32"] == 0 for r in rows) == 20 * 2 + 3
    moved = spark.range(20000).select("id", sharding.placed(sharding.F.col("id"), sharding.topology(40)).alias("a"), sharding.placed(sharding.F.col("id"), sharding.grown(sharding.topology(40))).alias("b"))
    n = moved.where("a <> b").count()
    assert 20000 / 41 * 0.8 < n < 20000 / 41 * 1.2
    sizes = [r["count"] for r in moved.groupBy("a").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * min(sizes)
    assert sharding.digest(empty(spark)).count() == 0


def test_sharding_draws(spark):
    """Every draw by hand, with unequal weights and a shard of weight 0."""
    shards = tuple(sharding.Shard(s // 6, s // 2, s, 0.0 if s == 5 else 1.0 + s % 3) for s in range(14))

    def child(level, names, key):
        def draw(name_weight):
            name, weight = name_weight
            u = (((spark_hash(level, name, np.int64(key)) & ((1 << 64) - 1)) >> 12) + 1.0) / float(1 << 52)
            return -math.log(u) / weight, name

        return min(map(draw, names.items()))[1]

    got = {r["id"]: r["s"] for r in spark.range(2000).select("id", sharding.placed(sharding.F.col("id"), shards).alias("s")).collect()}
    for key, placed in got.items():
        region = child("region", {g: sum(s.weight for s in shards if s.region == g) for g in {s.region for s in shards}}, key)
        rack = child("rack", {k: sum(s.weight for s in shards if s.rack == k) for k in {s.rack for s in shards if s.region == region}}, key)
        assert placed == child("shard", {s.shard: s.weight for s in shards if s.rack == rack and s.weight}, key)


def test_mixing(spark, words):
    docs = [(i, " ".join(words(5 + i % 40, i)), "en", None if i % 7 == 6 else f"s{(i * i) % 7}", 0) for i in range(600)] + [(700, None, None, "s9", 0), (701, "", None, None, 0)]
    df = spark.createDataFrame(docs, DOCS)
    rows = mixing.digest(df).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len((t or "").split())
    order = [*sorted(s for s in sizes if s is not None), None]
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    goal, open_, left = {}, list(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not full:
            goal |= {s: level * weights[s] for s in open_}
            break
        for s in full:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            open_.remove(s)
    taken = collections.Counter()
    for r in rows:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 60 for s in order) and len(rows) == len(docs)
    assert sorted(map(str, mixing.digest(df).collect())) == sorted(map(str, rows))
    assert mixing.mixed(df).count() == sum(r["epochs"] for r in rows)
    assert mixing.digest(df.union(df)).count() == 2 * len(docs) and mixing.digest(empty(spark)).count() == 0


def served_by_hand(docs, rows, seed=17):
    """Who is taken how often: every source's queue in order of the seeded hash, once per epoch, merged by finish time and cut at the budget."""
    targets = {r["source"]: r["target"] for r in rows}
    queues = collections.defaultdict(list)
    for i, t, _, s, _ in docs:
        fp = np.int64(spark_hash(7, t, t is None))
        key = None if i is None else np.int64(i)
        queues[s].append((spark_hash(seed, key, s, fp), i is not None, i or 0, int(fp), len((t or "").split())))
    order, taken = [], collections.Counter()
    for s, q in queues.items():
        total = sum(x[-1] for x in q)
        for epoch in (0, 1):
            at = 0
            for u, _, i, fp, n in sorted(q):
                at += n
                if n and targets[s]:
                    order.append(((at + epoch * total) / targets[s], s is None, s or "", at, epoch, u, i, fp, n))
    left = sum(targets.values()) + 0.5
    for *_, s, _, _, _, i, _, n in sorted(order):
        left -= n
        if left < 0:
            break
        taken[i, s] += 1
    return taken


@pytest.mark.parametrize("rows_a_range", [4_000, 3])
def test_mixing_serves_in_order_of_finish(spark, words, monkeypatch, rows_a_range):
    """Against a queue served one by one; with so small ranges that sums go through several spans."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(mixing, "SPAN", 7)
    docs = [(i, " ".join(words(3 + i % 23, i)), "en", None if i % 9 == 8 else f"s{(i * i) % 5}", 0) for i in range(400)]
    docs += [(1000 + i, "x " * 400, "en", f"s{i}", 0) for i in range(2)] + [(1100 + i, " ".join(words(10, 1)), "en", "s1", 0) for i in range(30)]
    rows = mixing.digest(spark.createDataFrame([(*d, 1, 2.0, 3) for d in docs], DOCS + ", size int, target double, taken int")).collect()
    expected = served_by_hand(docs, rows)
    assert {(r["doc_id"], r["source"] or ""): r["epochs"] for r in rows if r["epochs"]} == dict(expected) and set(expected.values()) == {1, 2}


def test_mixed_takes_all_of_equal_rows(spark, words):
    """Groups equal in id, text and source that the cut falls into, of equal rows and of rows that differ in other columns."""
    docs = [(g, " ".join(words(12, g)), f"l{i}" if g % 2 else "en", f"s{g % 5}", 0) for g in range(10) for i in range(41)]
    docs += [(None, "a b c", "en", None, 0)] * 53
    df = spark.createDataFrame(docs, DOCS)
    due, got = collections.Counter(), collections.Counter()
    for r in mixing.digest(df).collect():
        due[r["doc_id"], r["source"]] += r["epochs"]
    rows = mixing.mixed(df).collect()
    for r in rows:
        got[r["doc_id"], r["source"]] += 1
    assert got == +due and any(n % 41 for (i, _), n in due.items() if i is not None)
    times = collections.Counter(rows)
    assert set(map(tuple, rows)) <= set(docs) and all(abs(times[a] - times[b]) <= 1 for a in times for b in times if a[0] == b[0] and a[0] and a[0] % 2)
    assert sorted(map(str, mixing.mixed(df.repartition(5)).collect())) == sorted(map(str, rows))


def test_packing(spark, odd):
    docs = make(spark, odd, CLASHES, CLASH_VALUES)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.digest(docs.union(docs)).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(odd):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert sum(r["length"] for r in by_doc[i]) == 2 * len(ids)
        for r in by_doc[i]:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.sequences(docs).collect()
    assert all(len(r["ids"]) == 4 * 2048 for r in whole)
    assert packing.digest(empty(spark)).count() == 0


def test_encoder():
    """Against the tokenizer's own library: every code point, a special token's name, hostile and very long texts."""
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    assert encode.merge is not None
    rng = random.Random(5)
    texts = ["", " ", "a  b \n\n c ", "it's we'll I'M", "end<|endoftext|> of", "x" * 300_000, " " * 1_500_000, "\n" * 200_000 + "x", "!?" * 100_000, "".join(chr(rng.randrange(0x4E00, 0x6E00)) for _ in range(50_000))]
    texts += ["".join(rng.choice(" \n\t'.,aZ9é\u00a0\u2003\u0301한") for _ in range(40)) for _ in range(500)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}\n{chr(c)} " for c in points[lo : lo + 512]) for lo in range(0, len(points), 512)]
    for text, e in zip(texts, own.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encode(text) == np.array(e.ids, "<u4").tobytes(), text[:60]


def test_packing_of_equal_rows(spark):
    """Ties: rows equal in every way, and rows with a null id, each get a place of their own."""
    rows = [(i % 2 if i % 3 else None, "same words " * 3, None, None, 0) for i in range(300)]
    got = packing.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 300 and len({(r["sequence_id"], r["offset"]) for r in got}) == 300 and sum(r["doc_id"] is None for r in got) == 100


@pytest.mark.parametrize("window", [8, 31, 64])
def test_best_fit_decreasing(window):
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [rng.randint(1, window - 1) for _ in range(rng.randint(0, 90))]
        room = []
        for n in sorted(lengths, reverse=True):
            fits = [c for c in room if c >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(window - n)
        steps, windows = packing.plan(dict(collections.Counter(lengths)), window)
        assert windows == len(room) and (not steps or {s[0] for s in steps} == set(lengths))


def without_repeats(raws):
    """Of each byte string which bytes a 400-byte string covers that starts anywhere else too."""
    seen, marks = collections.Counter(), []
    for r in raws:
        seen.update(r[i : i + 400] for i in range(len(r) - 399))
    for r in raws:
        marks.append(np.zeros(len(r), bool))
        for p in range(len(r) - 399):
            if seen[r[p : p + 400]] > 1:
                marks[-1][p : p + 400] = True
    return marks


def test_suffix_dedup(spark, odd):
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    b = letters(900)
    texts = [*odd, b, letters(200) + b[100:700] + letters(300), letters(50) + b[250:651], "a" * 1500, "a" * 500 + letters(100), b[:399], "xyz " * 300, letters(100) + b[:420] + letters(10) + b[400:820], "\0" * 450, *(letters(100) + b[k : k + 500] + letters(100) for k in range(0, 400, 37))]
    for docs in (texts, texts[:3] + texts):
        raws = [(t or "").encode() for t in docs]
        got = {r["doc_id"]: r for r in suffix_dedup.digest(make(spark, docs, CLASHES, CLASH_VALUES)).collect()}
        for i, (r, mark) in enumerate(zip(raws, without_repeats(raws), strict=True)):
            kept = bytes(np.frombuffer(r, np.uint8)[~mark])
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(r), int(mark.sum()), hashlib.sha256(kept).hexdigest())
            assert got[i]["n_spans"] == int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum())
    same = make(spark, [b, "short"])
    twice = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digest(same.union(same)).collect()}
    assert twice == {0: len(b.encode()), 1: 0}
    assert suffix_dedup.digest(empty(spark)).count() == 0


@pytest.mark.parametrize(("hot", "batch"), [(5, 12_000), (40, 12_000), (5, 30)])
def test_suffix_dedup_of_a_hot_anchor(spark, monkeypatch, hot, batch):
    """A passage that all texts quote, whole or in part, between words of their own: its anchors are dealt by bands down to single distances."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "QUEUE", 16)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, before = letters(700), [letters(120) for _ in range(3)]
    texts = [letters(rng.randint(0, 200)) + rng.choice(before)[rng.randint(0, 119) :] + passage[rng.choice((0, 0, 3, 90)) : rng.choice((700, 690, 455, 395))] + letters(rng.randint(0, 150)) for _ in range(150)]
    raws = [t.encode() for t in texts]
    got = {r["doc_id"]: r for r in suffix_dedup.digest(make(spark, texts)).collect()}
    for i, (r, mark) in enumerate(zip(raws, without_repeats(raws), strict=True)):
        kept = bytes(np.frombuffer(r, np.uint8)[~mark])
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(mark.sum()), hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_texts_above_a_stretch(spark, monkeypatch):
    """A text of several stretches whose repeats lie across their borders, with a null doc_id among the documents."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    part = letters(900)
    texts = [letters(700) + part + letters(2500) + part[:500], letters(1990) + part[100:] + letters(90)]
    rows = [(None, texts[0], None, None, 0), (None, "short", None, None, 0), (1, texts[1], None, None, 0)]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.digest(spark.createDataFrame(rows, DOCS)).collect()}
    a, b = without_repeats([t.encode() for t in texts])
    assert got == {(None, len(texts[0])): a.sum(), (None, 5): 0, (1, len(texts[1])): b.sum()} and a.sum() >= 1400


def test_induced_order_with_spill(tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "QUEUE", 90)
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([5, 17, 30]))) for _ in range(400)]
    rank, common = suffix_dedup.induced(suffix_dedup.as_blocks(strings, 64, str(tmp_path)), str(tmp_path))
    padded = [s.ljust(64, b"\0") for s in strings]
    distinct = sorted(set(padded))
    assert all(distinct[r] == s for r, s in zip(rank, padded, strict=True))
    prefix = lambda a, b: next(i for i in range(64) if a[i] != b[i])
    assert [int(c) for c in common[1:]] == [prefix(a, b) for a, b in zip(distinct, distinct[1:], strict=False)]


def shingled(text, size):
    """The set of a text's shingles, as tuples of words."""
    w = [x for x in re.split("[ \\t\\n\\x0b\\x0c\\r]+", text or "") if x]
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_join(texts, size, threshold):
    sets = [shingled(t, size) for t in texts]
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= threshold * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return [(len(s), c) for s, c in zip(sets, top, strict=True)]


def test_boundary_follows_lists(spark, words):
    """Nothing shared: scanning wins. Elements shared and pairs not: enumerating wins as far as it can. The same measured on texts."""
    sizes = {n: 100 for n in range(3, 200)}
    found = [ngram_join.boundary(sizes, p, 0.0, 85) for p in (0.0, 0.3, 0.6, 1.0)]
    assert found == sorted(found) and found[0] < 7 and 20 < found[-1] and ngram_join.may_be_light(found[-1], 85)
    assert ngram_join.boundary(sizes, 1.0, 1.0, 85) < 7 and ngram_join.boundary({}, 1, 1, 85) == 0
    phrase = words(8, 3)
    alone = [" ".join(f"{x}{i}" for x in words(20, i)) for i in range(2000)]
    quoting = [" ".join([f"{x}{i % 450}" for x in phrase[: 1 + i % 7]] + [f"{x}{i}" for x in words(19, i)]) for i in range(2000)]
    measured = [ngram_join.scouted(make(spark, t).withColumn("fp", ngram_join.text_key(ngram_join.F.col("text"))), 1, 60)[1] for t in (alone, quoting)]
    assert measured[0] <= measured[1]


@pytest.mark.parametrize("light_to", [0, 9, 40, 10_000])
def test_ngram_join_at_any_boundary(spark, words, light_to, monkeypatch):
    """The boundary never changes the result; a phrase that most texts quote makes long lists across sizes."""
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: light_to)
    monkeypatch.setattr(ngram_join, "SENT", light_to)  # both ways to the texts
    rng, phrase, texts = random.Random(light_to), words(14, 77), []
    for g in range(40):
        base = words(rng.choice([8, 16, 30, 60]), 500 + g)
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "w%d" % rng.randint(0, 50)
            at = rng.randint(0, len(own))
            texts.append(" ".join(own[:at] + phrase + own[at:] if rng.random() < 0.7 else own))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.digest(make(spark, texts), 3, 60).collect()}
    assert [got[i] for i in range(len(texts))] == brute_join(texts, 3, 60)


def test_ngram_join_of_null_ids_and_long_texts(spark, words):
    long = words(30_000, 5)
    rows = [(None, "a b c d e f g"), (7, "A b c\nd e f g"), (None, None), (3, " ".join(long)), (5, " ".join([*long[:-9], "other"])), (3, " ".join(long)), (9, "")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_shingles"], r["component_id"]) for r in ngram_join.digest(docs).collect() if r["n_shingles"])
    assert [(i, c) for i, _, c in got] == [(-1, 7), (3, 3), (3, 3), (5, 3), (7, 7)]
    assert sum(r["n_shingles"] == 0 for r in ngram_join.digest(docs).collect()) == 2


@pytest.mark.parametrize(("size", "threshold"), [(4, 85), (5, 80), (2, 40)])
def test_ngram_join(spark, odd, words, size, threshold):
    rng, texts = random.Random(size), list(odd)
    for g in range(12):
        base = words(rng.choice([3, 6, 10, 25, 80]), 400 + g)
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "w%d" % rng.randint(0, 50)
            texts.append(" ".join(own).title() if rng.random() < 0.3 else " ".join(own))
    docs = make(spark, texts, CLASHES, CLASH_VALUES)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.digest(docs, size, threshold).collect()}
    assert [got[i] for i in range(len(texts))] == brute_join(texts, size, threshold)
    if size == 5:
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}
        assert ngram_join.digest(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for e in edges for x in e)


def test_language(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "and", "of"], "fr": ["eau", "de", "ré", "la", "aux"], "de": ["sch", "ung", "der", "keit", "ü"], "es": ["ción", "que", "los", "ñ", "mente"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 4]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 40))), lang, None, 0))
    rows += [(900, None, "en", None, 0), (901, "123 !?", "en", None, 0), (902, "the thing", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language_id.digest(docs).collect()}
    out = [i for i, *_ in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in out) / len(out) >= 0.95
    assert all(got[i]["held_out"] == (i in out) for i in range(240)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"
    assert language_id.digest(empty(spark)).count() == 0
    for n in (2, 4, 9, 20):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 4 else 4)
    long = "abc déf " * 70_000
    assert language_id.features(long).sum() == sum(len((" " + long + " ").encode()) - n + 1 for n in language_id.ORDERS)


def grams_by_hand(text):
    raw, found = (" " + text.lower() + " ").encode(), collections.Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 257 + b) % 2**32
            found[(h + n) * 2654435761 % 2**32 >> 17] += 1
    return found


def test_language_by_hand(spark):
    """Counts, log odds, weights and decoding written out, for languages with equal, few and no texts."""
    rows = [(i, t, lang, None, 0) for i, (t, lang) in enumerate([("la casa de la luna", "es"), ("the house of the moon", "en"), ("das haus am mond", "de"), ("the moon", "en"), ("la luna", "es"), (None, "xx"), ("of mond la", None), ("der mond", "de")] * 3)]
    docs = spark.createDataFrame(rows, DOCS)
    learned = [(t, lang) for i, t, lang, *_ in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({lang for _, lang in learned})
    counts = {lang: sum((grams_by_hand(t) for t, x in learned if x == lang), collections.Counter()) for lang in names}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    seen = sorted(set().union(*counts.values()))
    code = language_id.codewords(len(names))
    bits = range(code.shape[1])
    rate = lambda lang, b: (counts[lang][b] + 0.5) / (total[lang] + 0.5 * 32768)
    side = lambda k, j, b: (lambda own: sum(rate(x, b) for x in own) / len(own))([x for i, x in enumerate(names) if code[i][j] == k])
    split = [0 < sum(code[:, j]) < len(names) for j in bits]
    weight = {j: {b: math.log(side(1, j, b) / side(0, j, b)) for b in seen} for j in bits if split[j]}
    trust = [max(1e-3, sum((side(1, j, b) - side(0, j, b)) * weight[j][b] for b in seen)) if split[j] else 1.0 for j in bits]
    for r in language_id.digest(docs).collect():
        text = rows[r["doc_id"]][1]
        if text is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = grams_by_hand(text)
        margin = [sum(n * weight[j].get(b, 0.0) for b, n in own.items()) / sum(own.values()) if split[j] else 0.0 for j in bits]
        loss = [sum(trust[j] * math.log1p(math.exp(-language_id.STEEPNESS * (2 * code[i][j] - 1) * margin[j])) for j in bits) / sum(trust) for i in range(len(names))]
        assert r["lang_pred"] == names[loss.index(min(loss))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), rel=1e-9)


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than a task holds at once, the rarest of them with three documents: each is answered."""
    monkeypatch.setattr(language_id, "HELD", 30, raising=False)
    rng = random.Random(6)
    words = {f"l{k:02d}": ["".join(chr(0x4E00 + 12 * k + rng.randrange(12)) for _ in range(rng.randint(2, 6))) for _ in range(40)] for k in range(100)}
    rows = [(lang, " ".join(rng.choices(own, k=30))) for k, (lang, own) in enumerate(words.items()) for _ in range(12 if k < 70 else 3)]
    rng.shuffle(rows)
    model = language_id.trained(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == sorted(words) and len({tuple(c) for c in model.code}) == len(words)
    asked = spark.createDataFrame([(lang, " ".join(rng.choices(own, k=30))) for lang, own in words.items() for _ in range(3)], "lang string, text string")
    right = collections.Counter(r["lang"] for r in language_id.identified(asked, model).collect() if r["lang"] == r["lang_pred"])
    assert sum(right.values()) >= 0.95 * 300 and all(right[lang] for lang in words)


def good_turing(counts):
    """Discounts of counts 1 to 5 by counts of counts; 0.1 to 0.9 off each where those don't allow it."""
    n = [sum(c == r for c in counts) for r in range(1, 7)]
    if all(n):
        common = 6 * n[5] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common != 1 else -1 for r in range(1, 6)]
        if all(0 < x < 1 for x in d):
            return lambda c: c * d[c - 1] if c <= 5 else c
    off = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5))
    return lambda c: c - off if c <= 5 else c


class KatzByHand:
    """P(word | words before), by the definition, from lists of tokens that begin and end with None."""

    def __init__(self, texts, order):
        self.after = collections.defaultdict(collections.Counter)
        for t in texts:
            for m in range(order):
                for i in range(max(1, m), len(t)):
                    self.after[tuple(t[i - m : i])][t[i]] += 1
        self.one, self.less = self.after[()], {}
        self.total = sum(self.one.values())
        for m in range(order):
            self.less[m] = good_turing([c for h, s in self.after.items() if len(h) == m for c in s.values()])

    def __call__(self, history, word):
        seen = self.after.get(history)
        if not history:
            lost = sum(c - self.less[0](c) for c in self.one.values())
            scale = 1.0 if lost > 1e-12 else self.total / (self.total + 0.5)
            if word in self.one:
                return self.less[0](self.one[word]) * scale / self.total
            return lost / self.total if lost > 1e-12 else 0.5 / (self.total + 0.5)
        if not seen:
            return self(history[1:], word)
        n, less = sum(seen.values()), self.less[len(history)]
        mass = sum(map(less, seen.values()))
        scale = n / (n + 0.5) if n - mass < 1e-9 * n else 1.0
        if word in seen:
            return less(seen[word]) * scale / n
        return (1 - mass * scale / n) / (1 - sum(self(history[1:], x) for x in seen)) * self(history[1:], word)


@pytest.mark.parametrize(("small", "order"), [(False, 2), (True, 2), (False, 3), (True, 3), (True, 4)])
def test_lm(spark, odd, small, order, monkeypatch):
    if small:
        for name, value in (("BLOCK", 700), ("PART", 400), ("HOT", 60)):
            monkeypatch.setattr(lm_scoring, name, value)
    texts = [t for t in odd if len(t or "") < 20_000] * 3 + [" ".join(random.Random(k).choices(["x", "y", "z", "w"], k=60)) for k in range(40)]
    docs = make(spark, texts, CLASHES, CLASH_VALUES).withColumn("n_tokens", lm_scoring.F.lit("clash"))
    got = {r["doc_id"]: r for r in lm_scoring.scored(docs, lm_scoring.held_out(), order=order).withColumnsRenamed({"id": "doc_id", "held": "held_out"}).collect()}
    tokens = [[None, *(t or "").encode().lower().split(), None] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    model = KatzByHand([tokens[i] for i in train], order)
    before = lambda t, i: tuple(t[max(0, i - order + 1) : i])
    one, total = model.one, model.total
    for h in random.Random(1).sample(sorted(model.after, key=str), 12):
        assert abs(sum(model(h, x) for x in [*one, b"\0unknown"]) - 1) < 1e-9
    known = functools.cache(model.__call__)
    for i, t in enumerate(tokens):
        assert got[i]["score"] == pytest.approx(sum(math.log10(known(before(t, j), t[j])) for j in range(1, len(t))), rel=1e-9)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in t[1:]), rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(t) - 1, sum(one[w] > 0 for w in t[1:]), total, i not in train)
    if small and order == 2:
        assert lm_scoring.digest(empty(spark)).count() == 0
        long = spark.createDataFrame([(None, "a b " * 100_000, None, None, 0), (None, None, None, None, 0)], DOCS)  # one block, far above BLOCK
        assert sorted(r["n_tokens"] for r in lm_scoring.digest(long).collect()) == [1, 200_001]


@pytest.mark.parametrize("leaf", [1000, 20])
def test_embeddings(spark, leaf, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MAX_LEAF", 4 * leaf)
    rng, rows = np.random.default_rng(1), []
    for g in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + 0.05 * rng.standard_normal(16)).astype("f4").tolist(), g % 3))
    base = rng.standard_normal(16)
    rows += [(len(rows) + k, (base + 0.03 * rng.standard_normal(16)).astype("f4").tolist(), 0) for k in range(150)]
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], None), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [1.0, None], 0), (1006, [2.0] * 8, 0), (1007, [1.0] * 8, 0), (1008, [], 0), (1009, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, class int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, leaf=leaf).collect()}
    good = [(i, np.array(v, "f8"), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.defaultdict(set)
    for i, v, y in good:
        for j, u, z in good:
            if i != j and y == z and len(u) == len(v) and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.93:
                links[i].add(j)
    true, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and all(got[i]["n_links"] <= len(links[i]) for i in got)
    assert found == true if leaf == 1000 else found >= 0.9 * true
    for i in (1001, 1002, 1003, 1004, 1005, 1008, 1009):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[1007]["component_id"] == 1006 and got[1000]["component_id"] == 0
    for i, js in links.items():
        assert leaf < 1000 or all(got[i]["component_id"] == got[j]["component_id"] for j in js)


def test_embeddings_of_a_large_group(spark, monkeypatch):
    """A group far above a leaf's size, dealt over several blocks: every link counts, also of vectors at its rim and of copies."""
    monkeypatch.setattr(embedding_dedup, "MAX_LEAF", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 400)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rim = [base + rng.uniform(0.1, 0.35) * rng.standard_normal(16) for _ in range(100)]
    vectors = [base + 0.1 * rng.standard_normal(16) for _ in range(1500)] + rim + [rng.standard_normal(16) for _ in range(200)]
    vectors += vectors[:30]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, leaf=20).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    true, found = near.sum(axis=1) - 1, np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= true).all() and (found[:1500] == true[:1500]).all() and found.sum() >= 0.999 * true.sum()
    assert len({got[i]["component_id"] for i in range(1500)}) == 1


def test_pipeline(spark, tmp_path, odd, words):
    import corpus_pipeline

    texts = [*odd, *(" ".join(words(90, 700 + k)) for k in range(30)), *(" ".join([*words(90, 700 + k)[:-1], "end"]) for k in range(10))]
    make(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= seen
        seen = now
        if name == "n-gram jaccard join":
            rows = docs.collect()
            assert all(c == i for i, (_, c) in enumerate(brute_join([r["text"] for r in rows], 5, 80)))
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0 and last.count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_and_clashing_names(spark):
    """Every operator on documents: null ids beside others, rows that are equal in every way, and columns named like its own."""
    text = "\n".join(" ".join(f"{chr(97 + i)}{chr(97 + j)}word" for j in range(9)) for i in range(12))
    rows = [(None, text, "en", None, 0), (None, text, "en", None, 0), (None, None, None, None, 0), (3, text + "\nmore", "en", "s1", 0), (4, "la casa de la luna " * 9, "es", "s1", 0), (4, "", "es", "s2", 0)]
    docs = spark.createDataFrame([(*r, *CLASH_VALUES, 1.5, "z") for r in rows], DOCS + CLASHES + ", score double, lang_pred string")
    digests = [m.digest for m in (packing, suffix_dedup, mixing, language_id, sharding, lm_scoring, ngram_join, quality_rules)] + [line_dedup.deduped]
    for digest in digests:
        got = [r["doc_id"] for r in digest(docs).collect()]
        assert collections.Counter(got) == {None: 3, 3: 1, 4: 2}, digest.__module__
    for cleaned in (quality_rules.kept_documents, line_dedup.cleaned, ngram_join.one_of_each, mixing.mixed):
        assert cleaned(docs).columns == docs.columns and cleaned(docs).count() >= 1


def test_language_of_ties(spark):
    """Labels with the same texts tie in every bit; the first by code point answers, and the answer is ambiguous."""
    learned = spark.createDataFrame([(lang, t) for lang in ("zz", "aa") for t in ("the moon", "of the house")], "lang string, text string")
    (row,) = language_id.identified(spark.createDataFrame([("the house",)], "text string"), language_id.trained(learned)).collect()
    assert (row["lang_pred"], row["score"], row["ambiguous"]) == ("aa", 0.5, True)
