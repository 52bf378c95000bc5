"""Data sources `feeds` and `sitemaps`: the entries of a fetch log's feeds, in batches and as a stream.

    register(spark)
    spark.read.format("feeds").load("/log")
    spark.readStream.format("feeds").option("files_a_batch", 50).load("/log")

The log is a folder of Parquet files with url and content, to which fetchers add files. A partition is one row group of a file, so a large file is
read in many tasks and nothing is read twice. A stream's offset is the number of files it has taken, in order of name, and
with it the last name: files are never changed, and a later one has a later name, as a time in front makes it. A file that comes with an
earlier name is refused, rather than passed over. A stopped stream begins behind the last offset that its checkpoint has.

The folder is one that Python on driver and executors can open (a path or an address that pyarrow knows). Rows are raw entries;
`pages.feed_candidates` makes candidates of them. A damaged feed, a null content and an empty file have no entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewire.sources.pages import ENTRY, feed_entries, sitemap_rows


@dataclass
class RowGroup(InputPartition):
    """A row group of a log's file."""

    path: str
    number: int

    def __init__(self, path: str, number: int):
        super().__init__(None)
        self.path, self.number = path, number


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _names(folder: str) -> list[str]:
    """Names of a folder's finished files, in order; those that begin with a dot or an underscore are not there yet."""
    from pyarrow import fs

    files, at = _opened(folder)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")


def _groups(folder: str, names: Sequence[str]) -> list[RowGroup]:
    import pyarrow.parquet as pq

    files, at = _opened(folder)
    out = []
    for name in names:
        with files.open_input_file(f"{at}/{name}") as f:
            told = pq.ParquetFile(f).metadata
            out += [RowGroup(f"{folder}/{name}", k) for k in range(told.num_row_groups) if told.row_group(k).num_rows]
    return out


def _entries(group: RowGroup, kind: str) -> Iterator[tuple]:
    import pyarrow.parquet as pq

    files, at = _opened(group.path)
    with files.open_input_file(at) as f:
        for batch in pq.ParquetFile(f).iter_batches(64, [group.number], ["url", "content"]):
            for url, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in (feed_entries if kind == "feeds" else sitemap_rows)(content):
                    yield (url, *row)


class _Read(DataSourceReader):
    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def partitions(self) -> list[RowGroup]:
        return _groups(self.folder, _names(self.folder))

    def read(self, partition: RowGroup | None) -> Iterator[tuple]:
        return _entries(partition, self.kind) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    """Takes at most `most` files a batch."""

    def __init__(self, folder: str, kind: str, most: int):
        self.folder, self.kind, self.most = folder, kind, most
        self.taken: dict | None = None

    def initialOffset(self) -> dict:
        return {"files": 0, "last": ""}

    def latestOffset(self) -> dict:
        names = _names(self.folder)
        start = self.taken["files"] if self.taken else 0
        upto = min(len(names), start + self.most)
        self.taken = {"files": upto, "last": names[upto - 1] if upto else ""}
        return self.taken

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        self.taken = end if self.taken is None or self.taken["files"] < end["files"] else self.taken
        names = _names(self.folder)
        for offset in (start, end):
            if offset["files"] and (len(names) < offset["files"] or names[offset["files"] - 1] != offset["last"]):
                raise ValueError(f"{self.folder}: files before {offset['last']!r} have come or gone since they were read")
        return _groups(self.folder, names[start["files"] : end["files"]])

    def read(self, partition: RowGroup | None) -> Iterator[tuple]:
        return _entries(partition, self.kind) if partition is not None else iter(())

    def commit(self, end: dict) -> None:
        pass


class Feeds(DataSource):
    """Entries of feeds: page_url and what `pages.feed_entries` reads."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return f"page_url string, {ENTRY}"

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("the fetch log's folder is missing: load(path)")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> _Read:
        return _Read(self._folder(), self.name())

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self._folder(), self.name(), int(self.options.get("files_a_batch", 1000)))


class Sitemaps(Feeds):
    """Rows of sitemaps: page_url, kind, loc and lastmod as it is written."""

    @classmethod
    def name(cls) -> str:
        return "sitemaps"

    def schema(self) -> str:
        return "page_url string, kind string, loc string, lastmod string"


def register(spark: SparkSession) -> None:
    for source in (Feeds, Sitemaps):
        spark.dataSource.register(source)
