"""Centroid clustering of integer vectors, screened by the norms of their segments.

`kept_vectors` turns vectors into integers once and stores them with the squared norms of their segments: that
is the compressed vector. By Cauchy and Schwarz the product of two segments is at most the product of their norms, so

    |x - c|^2  >=  |x|^2 + |c|^2 - 2 * sum over segments |x_s| |c_s|,

which takes as many products as there are segments. A vector meets the centroids in order of this bound and
stops at the first whose bound lies above the distance found so far; only those before it get an exact integer
distance. Bounds are doubles and are lowered by more than their rounding error, so screening changes no result.

A round is one pass over the stored vectors: each task adds up its vectors by centroid and gives one row for each,
Spark adds these, and only the centroids' sums, `clusters` rows whatever the input, reach the driver.

Defined results: a vector that is null, of another length, or has a null or non-finite component is left out; a null
vec_id is kept and starts no centroid while others are left; rows equal in vec_id count each, ordered by components
where their hashes tie; with fewer vectors than centroids there are fewer centroids; an empty table gives no rows;
other columns are ignored, whatever their names. Integers beyond 2**26 in magnitude (components beyond a million)
would overflow a 64-bit distance and raise an error, as no row of theirs could hold its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import forget, stored

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Components a segment has.
SEGMENT = 4
#: Greatest magnitude of an integer component: 64 squared differences of twice that still fit into 63 bits.
LARGEST = 1 << 26
#: Relative rounding error that a bound is lowered by; that of a sum of some hundred doubles is far less.
SLACK = 1e-9


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def kept_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """vec_id, v (integer components) and norms (squared, by segment) of the vectors that count; stored."""
    x = F.col("embedding").cast("array<double>")
    good = vectors.select("vec_id", x.alias("x")).where((F.size("x") == dim) & F.forall("x", _finite))
    whole = F.transform("x", lambda c: F.floor(c * scale))
    checked = F.when(F.exists("v", lambda c: F.abs(c) > LARGEST), F.raise_error(F.lit(f"a component lies beyond {LARGEST // scale} in magnitude"))).otherwise(F.col("v"))
    squares = lambda i: F.aggregate(F.slice("v", i + 1, segment), F.lit(0).cast("long"), lambda a, c: a + c * c)
    ints = good.select("vec_id", whole.alias("v")).withColumn("v", checked)
    return stored(ints.select("vec_id", F.col("v").cast("array<int>").alias("v"), F.array(*(squares(i) for i in range(0, dim, segment))).alias("norms")), "vectors")


def starting(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes; `clusters` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid (ties: the smaller number) and its squared distance; how many exact distances that took."""
    own = np.stack([(centroids[:, i : i + segment] ** 2).sum(1) for i in range(0, centroids.shape[1], segment)], 1)
    both = norms.sum(1)[:, None] + own.sum(1).astype(np.float64)
    bound = both * (1 - SLACK) - 2 * np.sqrt(norms) @ np.sqrt(own).T - 1
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    which, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    open_, exact = np.arange(len(x)), 0
    for k in range(len(centroids)):
        open_ = open_[bound[open_, k] <= least[open_]]
        c = order[open_, k]
        d = ((x[open_] - centroids[c]) ** 2).sum(1)
        better = (d < least[open_]) | ((d == least[open_]) & (c < which[open_]))
        at = open_[better]
        which[at], least[at] = c[better], d[better]
        exact += len(open_)
    return which, least, exact


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)


def summed(kept: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """cluster, n, exact (distances computed) and sums (by component) of each task and centroid that has vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, exact = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0), batch.num_rows)
            which, _, more = nearest(x, _matrix(batch.column(1), batch.num_rows), centroids, segment)
            exact += more
            for c in range(len(centroids)):
                mine = which == c
                n[c] += mine.sum()
                sums[c] += x[mine].sum(0)
        some = np.flatnonzero(n)
        if len(some):
            lists = pa.array(sums[some].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array([exact, *[0] * (len(some) - 1)], pa.int64()), lists], ["cluster", "n", "exact", "sums"])

    return kept.select("v", "norms").mapInArrow(add, "cluster int, n long, exact long, sums array<long>")


def moved(kept: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The centroids after a round: floor of the mean of their vectors; those without vectors stay."""
    added = (F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1]))
    after = centroids.copy()
    for r in summed(kept, centroids, segment).groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return after


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, segment: int = SEGMENT) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of each vector that counts, stored, and the centroids."""
    kept = kept_vectors(vectors, dim, scale, segment)
    centroids = starting(kept, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids, segment)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, distance, _ = nearest(_matrix(batch.column(1), batch.num_rows), _matrix(batch.column(2), batch.num_rows), centroids, segment)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    out = stored(kept.select("vec_id", "v", "norms").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters")
    forget(kept)
    return out, centroids


def digest(vectors: DataFrame) -> DataFrame:
    rows, centroids = clustered(vectors)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))  # CLUSTERS rows at most
    own = own.select(F.col("cluster").alias("_c"), F.col("d").cast("long").alias("cluster_inertia"), F.sum("d").over(Window.partitionBy()).cast("long").alias("inertia"))
    name = F.array(*map(F.lit, names))[F.col("cluster")] if names else F.lit("")
    return rows.join(F.broadcast(own), F.col("cluster") == F.col("_c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", name.alias("centroid_sha256"))


def _sql() -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = {DIM})""",
        "parts AS MATERIALIZED (SELECT rid, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept)",
        f"start AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept QUALIFY c < {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS y FROM start JOIN parts USING (rid))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS (SELECT rid, c, sum((x - y) * (x - y))::BIGINT AS d FROM parts JOIN c{r} USING (i) GROUP BY rid, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM parts JOIN a{r} USING (rid) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c{r} LEFT JOIN m{r} USING (c, i))")
    steps.append(f"names AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{ROUNDS} JOIN kept USING (rid) JOIN names USING (c)"""


SQL = _sql()
