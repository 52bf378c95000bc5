"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target number of words (`targets`). Its documents stand in a queue in a seeded
random order, once per epoch; a document's virtual finish time is the words its source has queued up
to and including it, divided by the source's target. All queues are merged by finish time, which
serves every source in proportion to its target, and the merged queue is cut at the total budget.

Both running sums, within a source and over all, are taken in ranges: ranges of the shuffle key
within a source, ranges of finish time over all. Sums of ranges add up in spans of SPAN ranges, and only sums of
spans meet in one task, so a source with a third of all rows is spread like any other, and no task sorts more than
a range, a span or the spans: 10^10 rows make 2.5 million ranges and 2,500 spans.

Defined results: a null text has no words; a null source is a source, the last; a document without
words is never taken; rows that are equal in every way stand one behind the other, so the same number of
them is taken in every run; a source without words has target 0; an empty table gives no rows; a
mix's rows keep all columns, whatever their names; a null doc_id is an id like any other; a text's words are
counted whole, whatever its length; equal finish times are served in order of source, place and epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, stored, text_key

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Rows that one range should hold: few, as only a sum per range is gathered.
RANGE_ROWS = 4_000
#: Ranges that add up by themselves before their sum is added to the others'.
SPAN = 1_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, from one row (source, source_size) per source.

    Water filling: with level z, a source gets min(max_epochs * size, z * weight). Sources in
    order of max_epochs * size / weight fill up one after the other. What is left, divided by the weight of
    those not yet full, rises until the first source that can hold its share and falls after it, so its
    maximum is the level. One sort of the sources and running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("full_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
    s = s.withColumn("target", F.least(F.col("cap"), F.max("level").over(Window.partitionBy()) * F.col("weight")))
    return s.select("source", "source_size", "target")


def running_sum(rows: DataFrame, value: str, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """rows with the sum of `value` up to and including each row, per group, in order of bucket and then `order`.

    Sums of buckets are added up by themselves, in spans; rows meet only within their bucket.
    """
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_s")).withColumn("_span", F.floor(F.col(bucket) / SPAN))
    spans = sums.groupBy(*group, "_span").agg(F.sum("_s").alias("_all"))
    by = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_span").alias("_p"), F.coalesce(F.sum("_all").over(by), F.lit(0)).alias("_ahead"))
    same = F.col("_span") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    by = Window.partitionBy(*group, "_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_inside", F.coalesce(F.sum("_s").over(by), F.lit(0))).join(spans, same)
    keys = [*group, bucket]
    offsets = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.col("_ahead") + F.col("_inside")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.withColumn("_within", within).join(offsets, on).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within", *(f"_k{i}" for i in range(len(keys))))


def served(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """doc_id, text fingerprint, size, source, source_size, target and `epochs`, how often the mix takes the document; a row for each row of docs."""
    docs = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), text_key(F.col("text")).alias("fp"))
    rows = stored(docs.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "source", "fp")), "mix-rows")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)
    goal = stored(goal.select(F.col("source").alias("_source"), "source_size", "target"), "mix-targets")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    # the shuffle key, a uniform signed 64-bit number, in so many ranges
    at = F.floor((F.col("u").cast("double") / 2.0**64 + 0.5) * ranges)
    rows = running_sum(rows.withColumn("_range", at), "size", ["source"], "_range", [F.col("u"), F.col("doc_id"), F.col("fp")], "queued").drop("_range")
    # several rows for a document that may be served more than once
    queue = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).where("size > 0 AND target > 0")
    queue = queue.withColumn("finish", (F.col("queued") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    queue = queue.withColumn("_range", F.floor(F.least(F.col("finish"), F.lit(1e6)) * ranges))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("queued"), F.col("epoch"), F.col("u"), F.col("doc_id"), F.col("fp")]
    queue = running_sum(queue, "size", [], "_range", order, "served")
    cut = goal.agg(F.sum("target").alias("budget")).first()["budget"] or 0.0  # one number
    taken = queue.where(F.col("served") <= cut + 0.5).select("doc_id", "fp", "source", "queued")
    # a row of docs is one place in its source's queue
    counts = taken.groupBy("doc_id", "fp", "source", "queued").agg(F.count("*").alias("_epochs"))
    counts = counts.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("source").alias("_s"), F.col("queued").alias("_q"), "_epochs")
    # of rows without words several may share a place; they are never in the queue
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("queued") == F.col("_q")) & (F.col("size") > 0)
    return rows.join(counts, on, "left").select("doc_id", "fp", "source", "size", "source_size", "target", F.coalesce("_epochs", F.lit(0)).cast("int").alias("epochs"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes each. Where the cut falls inside a group of rows equal in id, text and source, the rows with the least hash of all columns get one take more."""
    told = served(docs, **options).groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("source").alias("_s")).agg(F.sum("epochs").alias("_takes"), F.count("*").alias("_n"))
    told = stored(told.where("_takes > 0").select("_d", "_f", "_s", F.expr("_takes div _n").alias("_each"), F.expr("_takes % _n").alias("_more")), "mix-takes")
    hashed = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d0"), text_key(F.col("text")).alias("_f0"), F.col("source").alias("_s0"), F.xxhash64(*hashed).alias("_h"))
    on = F.col("_d0").eqNullSafe(F.col("_d")) & (F.col("_f0") == F.col("_f")) & F.col("_s0").eqNullSafe(F.col("_s"))
    out = row.join(told.where("_each > 0"), on).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_each")))).select("_row.*")
    cut = told.where("_more > 0")
    if not cut.limit(1).count():
        return out
    # few groups, but any of them may be large: copies count as one row with a number, and numbers add up in ranges of the hash
    group = row.join(cut, on).groupBy("_d0", "_f0", "_s0", "_more", "_h").agg(F.first("_row").alias("_row"), F.count("*").alias("_k"))
    group = stored(group, "mix-cut")
    ranges = max(1, -(-group.count() // RANGE_ROWS))
    at = F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * ranges)
    group = running_sum(group.withColumn("_range", at), "_k", ["_d0", "_f0", "_s0"], "_range", [F.col("_h")], "_upto")
    extra = F.least(F.col("_k"), F.col("_more") - F.col("_upto") + F.col("_k"))
    return out.union(group.withColumn("_extra", extra).where("_extra > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_extra")))).select("_row.*"))


def digest(docs: DataFrame) -> DataFrame:
    return served(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("epochs") * F.col("size")).cast("long").alias("taken"), "source", "epochs")
