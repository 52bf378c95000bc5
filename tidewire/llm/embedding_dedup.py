"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of a label are one class with a count. Each tree halves the space again and again at the
median of a random projection, and what lies near the median goes to both sides (spill), so that close
vectors share a leaf in most trees. The top of the forest is fitted on a bounded sample and routes every
vector in one pass; leaves that are still too large, which are where the data is dense, are halved in
further rounds at their own medians. Within a leaf vectors are compared exactly, in double precision.

Halving parts a group of more than MAX_LEAF mutual near copies, so dense places are taken out before. With
`reach` the angle of the threshold, leaders are vectors of a hashed sample with several others of it within
reach; whatever is within twice the reach of a leader is core of the nearest one's ball, and all its links lie
within three times the reach. Every core vector is compared with all of those, exactly, block against block,
which gives its whole degree; vectors that are no core get their links to cores there too. The forest holds
only what is core nowhere. The sample decides where the exact comparison is made, never what counts.

A pair that shares several leaves counts in the least of them only, so degrees are summed without ever
writing a pair; for the components a leaf writes one link per vector, to the least vector it reaches
within the leaf. Components of all leaves' links are found by star rounds.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label or null vec_id, link with nothing, keep their own id as component and are kept; only
vectors of equal label and length are compared; rows that are equal in every way link with each other;
an empty table gives no rows; other columns are ignored, whatever their names; vectors may be of any length; of several
vec_ids of a component the least names it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import let, stored
from tidewire.llm.components import components

COSINE = 0.93
TREES = 8
LEAF = 1000
#: A leaf above this is halved again.
MAX_LEAF = 3000
#: Share of a node's vectors, on each side of the median, that goes to both children.
SPILL = 0.08
#: The trees' top is fitted on so many vectors at most, fewer if they are long: so many numbers reach the driver.
SAMPLE, SAMPLE_NUMBERS = 20_000, 1 << 21
#: Leaders come from a sample in which MAX_LEAF vectors have DENSE members on average, and have SOME of them near.
DENSE, SOME = 20, 4
#: Rows of a ball's block, fewer if vectors are long, and numbers in it.
BLOCK, BLOCK_NUMBERS = 8192, 1 << 23


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, finite throughout and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def direction(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF).standard_normal(dim)


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_top(x: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL) -> list[list[tuple[float, float]]]:
    """Per tree the (low, high) bounds of its nodes in heap order: projections <= high go left, >= low right."""
    out = []
    for t in range(trees):
        bounds, members = [], [np.arange(len(x))]
        for level in range(depth):
            p, below = x @ direction(t * 64 + level, x.shape[1]), []
            for m in members:
                lo, hi = np.quantile(p[m], [0.5 - spill, 0.5 + spill]) if len(m) else (0.0, 0.0)
                bounds.append((float(lo), float(hi)))
                below += [m[p[m] <= hi], m[p[m] >= lo]]
            members = below
        out.append(bounds)
    return out


def route(x: np.ndarray, top: list[list[tuple[float, float]]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs, sorted by row; leaf numbers are distinct across trees."""
    rows, leaves = [], []
    for t, bounds in enumerate(top):
        lo, hi = (np.array(b) for b in zip(*bounds, strict=True)) if bounds else (np.zeros(0), np.zeros(0))
        r, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(depth):
            p = (x @ direction(t * 64 + level, x.shape[1]))[r]
            left, right = p <= hi[node], p >= lo[node]
            r, node = np.concatenate([r[left], r[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        rows.append(r)
        leaves.append(node + (t << (depth + 1)))
    r, leaf = np.concatenate(rows), np.concatenate(leaves)
    order = np.argsort(r, kind="stable")
    return r[order], leaf[order]


def _matrix(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def routed(vecs: DataFrame, trees: int, leaf: int) -> DataFrame:
    """vecs with `codes`, the leaves of each vector. Leaves of different labels or lengths differ."""
    sizes = vecs.groupBy("label", "dim").agg(F.count("*").alias("n"))
    share = sizes.agg(F.max("n").alias("most")).first()["most"] or 0
    common = sizes.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    x = np.zeros((0, 1))
    if dim:
        table = vecs.where(F.col("dim") == dim).orderBy(F.xxhash64("class")).limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))).select("vec").toArrow()
        x = unit(_matrix(table, "vec"), dim)
    depth = min(max(0, math.ceil(math.log2(max(1, share) / leaf))), max(0, int(math.log2(max(1, len(x)) / 16))))
    top = fit_top(x, depth, trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list[int]] = [list(range(-trees, 0)) for _ in range(batch.num_rows)]  # other lengths: one leaf a tree
            own = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            if len(own):
                r, leaves = route(unit(_matrix(batch.take(pa.array(own)), "vec"), dim), top, depth)
                for i, part in zip(own, np.split(leaves, np.flatnonzero(np.diff(r)) + 1), strict=True):
                    lists[i] = part.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    schema = ", ".join(f"{c} {t}" for c, t in vecs.dtypes)
    out = vecs.mapInArrow(place, f"{schema}, leaves array<long>")
    return out.withColumn("codes", F.transform("leaves", lambda x: F.xxhash64(F.col("label"), F.col("dim"), x))).drop("leaves")


def halved(rows: DataFrame, limit: int, rounds: int = 40) -> DataFrame:
    """rows with every leaf of more than `limit` vectors halved, with spill, until none is left."""
    for _ in range(rounds):
        big = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        big = stored(big.select("code"), "large-leaves")
        if not big.limit(1).count():
            break
        members = rows.select("class", "dim", "vec", F.explode("codes").alias("code")).join(big, "code")

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, dims = batch.column("code").to_numpy(), batch.column("dim").to_numpy()
                p = np.empty(batch.num_rows)
                for code in np.unique(codes):  # a leaf has one direction, and vectors of one length
                    own = np.flatnonzero(codes == code)
                    dim = int(dims[own[0]])
                    p[own] = unit(_matrix(batch.take(pa.array(own)), "vec"), dim) @ direction(int(code), dim)
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("code"), pa.array(p)], ["class", "code", "p"])

        projected = stored(members.mapInArrow(project, "class long, code long, p double"), "projections")
        bounds = projected.groupBy("code").agg(F.percentile_approx("p", [0.5 - SPILL, 0.5 + SPILL], F.lit(2000)).alias("q"))
        sides = projected.join(bounds, "code").select("class", "code", F.explode(F.array_compact(F.array(F.when(F.col("p") <= F.col("q")[1], F.xxhash64("code", F.lit(0))), F.when(F.col("p") >= F.col("q")[0], F.xxhash64("code", F.lit(1)))))).alias("child"))
        moves = sides.groupBy("class").agg(F.collect_set("code").alias("old"), F.collect_set("child").alias("new"))
        joined = rows.join(moves, "class", "left")
        codes = F.when(F.col("old").isNull(), F.col("codes")).otherwise(F.array_union(F.array_except("codes", "old"), "new"))
        rows = stored(joined.select(*(c for c in rows.columns if c != "codes"), codes.alias("codes")), "halved")
    return rows


def compared(table: pa.Table, cosine: float) -> pa.Table:
    """One leaf: per vector with a link, its links that count here and the least class it reaches here."""
    code = table.column("code")[0].as_py()
    dim = table.column("dim")[0].as_py()
    x = unit(_matrix(table, "vec"), dim)
    ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
    near = (x @ x.T) >= cosine
    np.fill_diagonal(near, False)
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return pa.table({"class": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
    near, ids, copies = near[np.ix_(some, some)], ids[some], copies[some]
    lists = table.column("codes").take(pa.array(some)).to_pylist()
    before = [[c for c in own if c < code] for own in lists]
    known = {c: i for i, c in enumerate(sorted({c for own in before for c in own}))}
    inside = np.zeros((len(some), max(1, len(known))), np.float32)
    for i, own in enumerate(before):
        inside[i, [known[c] for c in own]] = 1
    counts = near & ((inside @ inside.T) == 0)
    links = counts.astype(np.float64) @ copies
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    least = rank.copy()
    while True:
        new = np.minimum(least, np.where(near, least[None, :], len(ids)).min(axis=1))
        new = np.minimum(new, new[order[new]])  # jump
        if (new == least).all():
            break
        least = new
    return pa.table({"class": ids, "links": links.astype(np.int64), "least": ids[order[least]]})


def leading(table: pa.Table, cosine: float) -> pa.Table:
    """One label's sample: of the vectors that have SOME others near, so many that each of these is near one."""
    x, ids = unit(_matrix(table, "vec"), table.column("dim")[0].as_py()), table.column("class").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = x[order]
    near = np.concatenate([(x[lo : lo + 512] @ x.T >= cosine).sum(axis=1) - 1 for lo in range(0, len(x), 512)])
    left, chosen = near >= SOME, []
    for i in np.argsort(-near, kind="stable"):
        if left[i]:
            chosen.append(i)
            left &= x @ x[i] < cosine
            left[i] = False
    return table.select(["space", "class", "vec"]).take(pa.array(order[np.array(chosen, np.int64)]))


def balled(classes: DataFrame, cosine: float, limit: int) -> tuple[DataFrame, bool]:
    """classes with `ball`, the ball whose core a vector is in (or null), and `balls`, those within which its links to cores lie; whether there are any."""
    spaced = classes.withColumn("space", F.xxhash64("label", "dim"))
    sample = spaced.where(F.pmod(F.xxhash64("class", F.lit(3)), F.lit(max(1, limit // DENSE))) == 0).select("space", "class", "dim", "vec")

    def lead(table: pa.Table) -> pa.Table:
        return leading(table, cosine)

    found = sample.groupBy("space").applyInArrow(lead, "space long, class long, vec array<double>").collect()  # fewer than the sample's dense places
    spaces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for space in {r["space"] for r in found}:
        own = sorted((r["class"], r["vec"]) for r in found if r["space"] == space)
        spaces[space] = (np.array([c for c, _ in own], np.int64), unit(np.array([v for _, v in own]), len(own[0][1])))
    sent = classes.sparkSession.sparkContext.broadcast(spaces)
    reach = math.acos(cosine)
    core, whole = (math.cos(min(math.pi, k * reach)) - 1e-9 for k in (2, 3))  # the triangle inequality, and room for rounding

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball: list[int | None] = [None] * batch.num_rows
            balls: list[list[int]] = [[] for _ in range(batch.num_rows)]
            space = batch.column("space").to_numpy()
            for s in np.unique(space):
                if s not in sent.value:
                    continue
                names, leaders = sent.value[s]
                own = np.flatnonzero(space == s)
                x = unit(_matrix(batch.take(pa.array(own)), "vec"), leaders.shape[1])
                for lo in range(0, len(own), 1024):
                    near = x[lo : lo + 1024] @ leaders.T
                    best = near.argmax(axis=1)
                    for i, row, b in zip(own[lo : lo + 1024], near, best, strict=True):
                        ball[i] = int(names[b]) if row[b] >= core else None
                        balls[i] = names[row >= whole].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball, pa.int64()), pa.array(balls, pa.list_(pa.int64()))], [*batch.schema.names, "ball", "balls"])

    schema = ", ".join(f"{c} {t}" for c, t in spaced.dtypes)
    return stored(spaced.mapInArrow(place, f"{schema}, ball long, balls array<long>"), "balls"), bool(spaces)


def crossed(table: pa.Table, cosine: float) -> pa.Table:
    """A block of a ball's core against a block of all the ball: per vector with a link, its links that count here and the least class it reaches here."""
    dim = table.column("dim")[0].as_py()
    inner = table.column("inner").to_numpy()
    x, ids, copies, free = unit(_matrix(table, "vec"), dim), table.column("class").to_numpy(), table.column("copies").to_numpy(), table.column("free").to_numpy()
    a, b = np.flatnonzero(inner), np.flatnonzero(~inner)
    near = np.empty((len(a), len(b)), bool)
    for lo in range(0, len(a), 512):
        part = a[lo : lo + 512]
        near[lo : lo + 512] = (x[part] @ x[b].T >= cosine) & (ids[part][:, None] != ids[b][None, :])
    links = np.zeros(len(ids), np.int64)
    for lo in range(0, len(a), 512):
        part = near[lo : lo + 512]
        links[a[lo : lo + 512]] = part.astype(np.float64) @ copies[b]
        links[b] += (copies[a[lo : lo + 512]].astype(np.float64) @ part).astype(np.int64)
    links[b[~free[b]]] = 0  # a core's links are counted in its own ball, all of them
    across, least = np.ascontiguousarray(near.T), np.full(len(ids), np.iinfo(np.int64).max)
    rows_left, cols_left = near.any(axis=1), across.any(axis=1)
    linked = np.concatenate([a[rows_left], b[cols_left]])
    for start in range(len(a)):
        if not rows_left[start]:
            continue
        rows, met = np.array([start]), []
        rows_left[start] = False
        while len(rows):
            met.append(a[rows])
            cols = np.flatnonzero(near[rows].any(axis=0) & cols_left)
            cols_left[cols] = False
            met.append(b[cols])
            rows = np.flatnonzero(across[cols].any(axis=0) & rows_left)
            rows_left[rows] = False
        group = np.concatenate(met)
        least[group] = ids[group].min()
    return pa.table({"class": ids[linked], "links": links[linked], "least": least[linked]})


def inside_balls(placed: DataFrame, cosine: float) -> DataFrame:
    """class, links, least as `compared` gives them, of all links that a core has."""
    rows = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.max("dim"))))
    cores = placed.where("ball IS NOT NULL").groupBy("ball").agg(F.ceil(F.count("*") / rows).alias("across"))
    spread = placed.select("dim", F.explode("balls").alias("ball")).groupBy("ball").agg(F.ceil(F.count("*") / rows).alias("down"))
    sizes = stored(cores.join(spread, "ball"), "ball-sizes")
    block, columns = F.xxhash64("class", F.lit(11)), ["class", "dim", "copies", "vec"]
    inner = placed.where("ball IS NOT NULL").join(sizes, "ball").select("ball", F.pmod(block, "across").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("j"), F.lit(True).alias("inner"), F.lit(False).alias("free"), *columns)
    outer = placed.select(F.explode("balls").alias("_ball"), F.col("ball").isNull().alias("free"), *columns).withColumnRenamed("_ball", "ball").join(sizes, "ball")
    outer = outer.select("ball", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("i"), F.pmod(block, "down").alias("j"), F.lit(False).alias("inner"), "free", *columns)

    def cross(table: pa.Table) -> pa.Table:
        return crossed(table, cosine)

    return inner.union(outer).groupBy("ball", "i", "j").applyInArrow(cross, "class long, links long, least long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    ok = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("dim", F.size("vec")).withColumn("class", F.when(ok, let(F.transform("vec", lambda x: x + 0.0), lambda v: F.xxhash64(F.col("label"), v))))
    members = stored(rows.select("vec_id", "class"), "members")
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = stored(first, "classes")
    limit = max(MAX_LEAF, 3 * leaf)
    spread, dense = balled(classes.drop("least_id"), cosine, limit)
    free = spread.where("ball IS NULL").drop("space", "ball", "balls")
    placed = halved(stored(routed(free, trees, leaf), "routed"), limit)
    leaves = placed.withColumn("code", F.explode("codes")).select("code", "class", "dim", "copies", "codes", "vec")

    def compare(table: pa.Table) -> pa.Table:
        return compared(table, cosine)

    found = leaves.groupBy("code").applyInArrow(compare, "class long, links long, least long")
    found = stored(found.union(inside_balls(spread, cosine)) if dense else found, "links")
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("class").alias("a"), F.col("least").alias("b")))
    named = classes.select("class", "copies", "least_id").join(degree, "class", "left").join(reach.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = named.join(ids, "component").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id")
    out = members.join(told, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def digest(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
