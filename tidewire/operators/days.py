"""Stories in partitions of their local day, with totals of each day kept beside them.

A batch rewrites the days that its rows fall into, late rows too, and computes those days' totals anew; every other day keeps its files.
Archive, neighbours, counts and last-modified times are sums and maxima of the totals, so no story is read for them, and a range of days
reaches the scan as a filter of partitions.

Where days are many and small, a partition is a span of days, as long as it takes to keep partitions few or full: a table's files grow with its
rows and not with its days. The day is then a column of the rows, which stand in its order. A merge that makes more partitions than that widens the span and rewrites
the table once; spans double, so that seldom happens.

Defined results: a row without a time has the day null, which no range holds; of rows with one key the last batch counts, and if a key
comes with another day the row moves, if `moves` is asked for (it reads the keys of all days); an empty batch changes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.dates import ZONE
from tidewire.operators.listing import local
from tidewire.operators.state import upserted
from tidewire.operators.versions import VersionedTable

TOTALS = "source_id int, category string, n long, newest timestamp"
#: Files of one partition at most, so that no task writes a day alone, however many stories it has, and the rows from which on there is another.
FILES_A_DAY, ROWS_A_FILE = 8, 250_000
#: Partitions that a table may have whatever they hold, and the rows that they must have on average if it has more.
PARTITIONS, ROWS_A_PARTITION = 128, 10_000
EPOCH = dt.date(1970, 1, 1).toordinal()
NONE = "__HIVE_DEFAULT_PARTITION__"


class DayStore(VersionedTable):
    """Rows by the local day of `ts`; they have `key`, source_id and categories."""

    def __init__(self, spark: SparkSession, path: str, schema: str, ts: str = "published_at", key: str = "id", zone: str = ZONE, **lease):
        super().__init__(spark, path, schema, **lease)
        self.ts, self.key, self.zone = ts, key, zone

    def _day(self) -> Column:
        return F.to_date(local(self.ts, self.zone))

    @staticmethod
    def _span(manifest: dict) -> int:
        """The days of a partition."""
        return next((int(name.split("/")[1]) for name in manifest["files"] if name.startswith("span/")), 1)

    def _start(self, day: Column, span: int) -> Column:
        """The first day of the partition that a day falls into."""
        n = F.unix_date(day)
        return day if span == 1 else F.date_from_unix_date(n - F.pmod(n, F.lit(span)))

    def _fitting(self, before: dict, told: DataFrame) -> int:
        """The span that keeps partitions few or full when some rows have come in. It never shrinks."""
        span = self._span(before)
        ends = [F.count("*").alias("n"), F.countDistinct(self._start(F.col("day"), span)).alias("k"), F.unix_date(F.min("day")).alias("lo"), F.unix_date(F.max("day")).alias("hi")]
        new = told.agg(*ends).first()
        held = [dt.date.fromisoformat(name.split("/")[1]).toordinal() - EPOCH for name in before["files"] if name.startswith("rows/") and not name.endswith(NONE)]
        if len(held) + new["k"] <= PARTITIONS:
            return span
        rows = new["n"] + (self._open(self._files(before, "rows"), self.schema, span).count() if held else 0)
        days = [x for x in (new["lo"], new["hi"], *held) if x is not None]
        most = max(PARTITIONS, rows // ROWS_A_PARTITION)
        while (max(days) - min(days)) // span + 1 > most:
            span *= 2
        return span

    def _files(self, manifest: dict, kind: str, starts: set[str] | None = None) -> list[str]:
        return [f for name, files in sorted(manifest["files"].items()) for f in files if name.startswith(f"{kind}/") and (starts is None or name.split("/")[1] in starts)]

    def _open(self, files: list[str], schema: str, span: int) -> DataFrame:
        """Rows of some files with their day, which is a column of the folders: a filter on it opens no other day's files. In spans it is one of the rows."""
        whole = f"{schema}, batch string, part string, day date" if span == 1 else f"{schema}, day date, batch string, part string, start date"
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], whole)
        return rows.drop("batch", "part", "start")

    def _written(self, rows: DataFrame, part: str, batch: str, span: int, *spread: Column) -> dict[str, list[str]]:
        at, by = f"data/batch={batch}/part={part}", "day" if span == 1 else "start"
        rows = rows if span == 1 else rows.withColumn(by, self._start(F.col("day"), span))
        rows.repartition(by, *spread).sortWithinPartitions(by, "day").write.partitionBy(by).parquet(f"{self.path}/{at}")
        out: dict[str, list[str]] = {}
        for file in self.folder.found(f"{at}/{by}=*/*.parquet"):
            folder, name = file.split("/")[-2:]
            out.setdefault(f"{part}/{folder.removeprefix(f'{by}=')}", []).append(f"{at}/{folder}/{name}")
        return out

    def with_days(self) -> DataFrame:
        """All rows with their day."""
        now = self.manifest()
        self._read = now["version"]
        return self._open(self._files(now, "rows"), self.schema, self._span(now))

    def read(self) -> DataFrame:
        return self.with_days().select(*self.columns)

    def between(self, first: dt.date, last: dt.date) -> DataFrame:
        """Rows of a range of local days."""
        return self.with_days().where(F.col("day").between(F.lit(first), F.lit(last)))

    def totals(self) -> DataFrame:
        """day, source_id, category, n, newest: a day's numbers by source (category null), and by category (source_id null)."""
        now = self.manifest()
        return self._open(self._files(now, "totals"), TOTALS, self._span(now))

    def write(self, rows: DataFrame, batch: int | None = None) -> int:
        raise NotImplementedError("rows come in by merge")

    def _spread(self, rows: DataFrame, span: int) -> Column:
        """By which rows of a large partition go to several files; the small ones, mostly all, have one."""
        sizes = rows.groupBy(self._start(F.col("day"), span).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") > ROWS_A_FILE).collect()  # at most a row per ROWS_A_FILE
        out = F.lit(0)
        for r in sizes:
            pieces = min(FILES_A_DAY, r["n"] // ROWS_A_FILE + 1)
            out = F.when(self._start(F.col("day"), span).eqNullSafe(F.lit(r["start"])), F.pmod(F.xxhash64(self.key), F.lit(pieces)).cast("int")).otherwise(out)
        return out

    def merge(self, changes: DataFrame, batch: int | None = None, moves: bool = False) -> int:
        """The next version, with these rows new or in place of those with their key."""
        before, own, scratch = self._before(), uuid.uuid4().hex, f"data/{uuid.uuid4().hex}"
        try:
            changes.select(*self.columns).withColumn("day", self._day()).write.parquet(f"{self.path}/{scratch}")
            told = self.spark.read.parquet(f"{self.path}/{scratch}")
            had, span = self._span(before), self._fitting(before, told)
            touched = told.select("day")
            if moves:
                there = self._open(self._files(before, "rows"), self.schema, had).select(self.key, "day")
                touched = touched.unionByName(there.join(told.select(self.key), self.key, "left_semi").select("day"))
            touched = touched.select(self._start(F.col("day"), span).alias("start")).distinct()
            starts = {NONE if r["start"] is None else r["start"].isoformat() for r in touched.collect()}  # no more than there are partitions
            if not starts:
                return before["version"]
            if span != had:
                starts |= {name.split("/")[1] for name in before["files"]}  # all is written anew
            old = self._open(self._files(before, "rows", starts), self.schema, had).select(*self.columns)
            rows = upserted(old, told.select(*self.columns), self.key).withColumn("day", self._day())
            files = self._written(rows, "rows", own, span, self._spread(rows, span))
            stored = self._open([f for fs in files.values() for f in fs], self.schema, span)
            numbers = [F.count("*").alias("n"), F.max(self.ts).alias("newest")]
            by_source = stored.groupBy("day", "source_id").agg(*numbers).withColumn("category", F.lit(None).cast("string"))
            by_category = stored.select("day", F.explode("categories").alias("category"), self.ts).groupBy("day", "category").agg(*numbers).withColumn("source_id", F.lit(None).cast("int"))
            columns = ["day", *(c.split()[0] for c in TOTALS.split(", "))]
            files |= self._written(by_source.select(*columns).unionByName(by_category.where("category IS NOT NULL").select(*columns)), "totals", own, span)
            rest = {name: f for name, f in before["files"].items() if name.split("/")[1] not in starts and not name.startswith("span/")}
            files |= {f"span/{span}": []} if span > 1 else {}
            return self._publish(before, rest | files, batch, f"data/batch={own}")
        finally:
            self.folder.remove(scratch)


def _by_source(totals: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    rows = totals.where("category IS NULL")
    return rows if hidden is None else rows.join(hidden.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def day_counts(totals: DataFrame, year: int, month: int) -> DataFrame:
    """day, n of one local month, newest first; only that month's partitions are opened."""
    first = dt.date(year, month, 1)
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return _by_source(totals).where(F.col("day").between(F.lit(first), F.lit(last))).groupBy("day").agg(F.sum("n").alias("n")).orderBy(F.desc("day"))


def month_counts(totals: DataFrame) -> DataFrame:
    """year, month, n, newest first."""
    rows = _by_source(totals).groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.sum("n").alias("n"))
    return rows.orderBy(F.desc("year"), F.desc("month"))


def neighbour_days(totals: DataFrame, day: dt.date) -> DataFrame:
    """before, after: the nearest days with stories."""
    return _by_source(totals).agg(F.max(F.when(F.col("day") < F.lit(day), F.col("day"))).alias("before"), F.min(F.when(F.col("day") > F.lit(day), F.col("day"))).alias("after"))


def sitemap_times(totals: DataFrame, sources: DataFrame, hide: tuple[str, ...] = ()) -> DataFrame:
    """kind (all, category, source, day, month), name, newest: a day's maxima once more aggregated. Hidden sources count for categories and sources only."""
    newest, dated = F.max("newest").alias("newest"), F.col("day").isNotNull()
    days = _by_source(totals, sources.where(F.col("slug").isin(list(hide)))).groupBy("day").agg(newest)
    kind = lambda rows, k, name: rows.select(F.lit(k).alias("kind"), name.alias("name"), "newest")
    named = sources.select(F.col("id").alias("source_id"), "slug")
    parts = [
        kind(days.agg(newest), "all", F.lit("")),
        kind(totals.where("category IS NOT NULL").groupBy("category").agg(newest), "category", F.col("category")),
        kind(_by_source(totals).groupBy("source_id").agg(newest).join(named, "source_id"), "source", F.col("slug")),
        kind(days.where(dated), "day", F.col("day").cast("string")),
        kind(days.where(dated).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(newest), "month", F.col("month")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
