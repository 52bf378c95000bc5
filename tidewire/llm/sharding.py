"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards; a node weighs what its shards weigh. A row
descends it: at every level each child draws -ln(u) / weight, with u a hash of the row's key and the
child's name, and the smallest draw wins. That is a weighted rendezvous at every level, so a child is
chosen in proportion to its weight, and a change of weights moves rows only into or out of children
whose weight has changed; the rest of the tree keeps its rows. `grown` puts a new shard into a region of
its own, so that only one child of the root is new and every row that moves lands on that shard.

The descent is a projection: nothing is shuffled to place a row. Slots within a shard are ranks, which
are computed in buckets of the key's hash, so that no task holds a whole shard.

Defined results: a null key is a key like any other (all such rows share a shard); a null text has no
bytes; rows that are equal in key and text share a shard and take consecutive slots; an empty table
gives no rows; other columns are ignored, whatever their names; a text of any length counts whole; of draws that
tie the smaller name wins. Rows that are equal in key and text share a bucket, which a task numbers in a stream that
spills, however many they are.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import let

#: Rows that one bucket of a shard should hold when slots are ranked.
BUCKET_ROWS = 50_000
OVERHEAD = 16


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, per_rack: int = 4, racks: int = 2) -> tuple[Shard, ...]:
    """n_shards equal shards, filling racks and regions in order."""
    return tuple(Shard(s // (per_rack * racks), s // per_rack, s) for s in range(n_shards))


def grown(shards: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a rack and region of its own."""
    return (*shards, Shard(max(s.region for s in shards) + 1, max(s.rack for s in shards) + 1, max(s.shard for s in shards) + 1, weight))


Children = list[tuple[int, float]]


def _choose(key: Column, level: str, children: Column) -> Column:
    """The child with the smallest draw -ln(u) / weight, with u in (0, 1] from 52 bits of a hash; the smaller name wins a tie."""

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), c["name"], key), 12).cast("double") + 1.0) / float(1 << 52)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def _literal(children: Children) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in children))


def placed(key: Column, shards: tuple[Shard, ...]) -> Column:
    """The shard of a row with this key: three draws, one per level."""
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    leaves: dict[int, dict[int, float]] = defaultdict(dict)
    for s in shards:
        if s.weight > 0:
            regions[s.region] += s.weight
            racks[s.region][s.rack] += s.weight
            leaves[s.rack][s.shard] = s.weight

    def below(tree: dict[int, dict[int, float]], parent: Column) -> Column:
        return F.create_map(*(x for p, c in sorted(tree.items()) for x in (F.lit(p), _literal(sorted(c.items())))))[parent]

    region = _choose(key, "region", _literal(sorted(regions.items())))
    return let(region, lambda r: let(_choose(key, "rack", below(racks, r)), lambda k: _choose(key, "shard", below(leaves, k))))


def with_slots(rows: DataFrame, group: str, order: list[Column], spread: Column, n_rows: int, out: str) -> DataFrame:
    """rows with a gapless rank from 0 within each value of `group`: ranks of buckets plus the buckets' offsets.

    spread is a hash that deals a group's rows over buckets; only the counts of buckets meet in one place.
    """
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(spread, F.lit(buckets)))
    counts = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    joined = ranked.join(offsets, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_g", "_b", "_before", "_rank", "_bucket")


def sharded(docs: DataFrame, shards: tuple[Shard, ...], after: tuple[Shard, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, if `after` is given, the shard under that topology."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("shard", placed(F.col("doc_id"), shards))
    rows = rows.withColumn("grown_shard", placed(F.col("doc_id"), after) if after else F.lit(None).cast("int"))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return with_slots(rows, "shard", order, F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"), docs.count() // max(1, len(shards)), "slot")


def digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    shards = topology(n_shards)
    return sharded(docs, shards, grown(shards)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
