"""A data source for what a connector has recorded page by page: items of a feed behind cursors, in batch and as a stream.

``spark.read.format("recorded_pages").option("path", ...)`` and ``spark.readStream`` give feed, cursor and the item as JSON. A
feed is a folder; its pages are files ``<cursor>.json``: an object with ``items`` (a list) and ``next`` (the cursor of the page
after it; null, or a page that isn't there yet: the feed ends so far). The first page is ``start.json``. No network is used: a
connector writes pages, and this reads them, in tasks, one for each feed.

A stream's offset is the next cursor of each feed, so a stopped stream goes on at its cursors. A cursor that leads back to a
page that was read before is refused, as it would never end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.canonical import canonical_documents
from .registry import register_source
from .schema import RAW_ITEM

FORMAT, FIRST = "recorded_pages", "start"


class Circle(ValueError):
    """A cursor that does not advance."""


class Feed(InputPartition):
    """Pages of a feed from one cursor on, up to another one (which is not read), or to the end."""

    def __init__(self, name: str, start: str, end: str | None = None):
        self.name, self.start, self.end = name, start, end


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _feeds(path: str) -> list[str]:
    from pyarrow import fs

    system, base = _files(path)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory)


def walk(path: str, feed: Feed) -> Iterator[tuple[str, dict]]:
    """The cursors and pages of a feed in order."""
    from pyarrow import fs

    system, base = _files(path)
    cursor, seen = feed.start, set()
    while cursor and cursor != feed.end:
        if cursor in seen:
            raise Circle(f"{feed.name}: cursor {cursor} does not advance")
        seen.add(cursor)
        name = f"{base}/{feed.name}/{cursor}.json"
        if system.get_file_info(name).type != fs.FileType.File:
            return
        with system.open_input_stream(name) as f:
            page = json.loads(f.read())
        yield cursor, page
        cursor = page.get("next")


class _Reader:
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: Feed) -> Iterator[tuple]:
        for cursor, page in walk(self.path, partition):
            for item in page.get("items") or []:
                yield partition.name, cursor, json.dumps(item, ensure_ascii=False)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Feed]:
        return [Feed(name, FIRST) for name in _feeds(self.path)]


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are the next cursor of each feed, or after @ the last page where it names none: what comes after is read then."""

    def initialOffset(self) -> dict:
        return {}

    def _last(self) -> dict:
        out = {}
        for name in _feeds(self.path):
            for cursor, page in walk(self.path, Feed(name, FIRST)):
                out[name] = page.get("next") or f"@{cursor}"
        return out

    def latestOffset(self) -> dict:
        return self._last()

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        out = []
        for name, last in end.items():
            begin = start.get(name, FIRST)
            if begin == last:
                continue
            if begin.startswith("@"):  # that page had no next one when it was read
                begin = next((p.get("next") for c, p in walk(self.path, Feed(name, begin[1:]))), None)
            stop = last if not last.startswith("@") else next((p.get("next") for _, p in walk(self.path, Feed(name, last[1:]))), None)
            if begin:
                out.append(Feed(name, begin, stop))
        return out

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the stream's own checkpoint."""


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "feed string, cursor string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def recorded(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """feed, cursor, item of all recorded pages, or a stream of them."""
    spark.dataSource.register(RecordedPages)
    return (spark.readStream if stream else spark.read).format(FORMAT).option("path", path).load()


@register_source("recorded_pages")
class RecordedSource:
    """Issues and change requests from recorded pages; a feed is named ``<kind>`` or ``<anything>-<kind>`` with kind issues or prs.

    An item that stands on several pages (it moved while pages were pulled) counts once: its last update.
    """

    def __init__(self, config: Mapping):
        self.path, self.repo, self.component, self.specs = config["path"], config["repo"], config["component"], config.get("components", {})

    def items(self, pages: DataFrame) -> DataFrame:
        """Raw items as ``canonical_documents`` takes them, of rows of ``recorded``."""
        raw = pages.select(F.col("feed").rlike("(^|-)prs$").alias("pr_feed"), F.from_json("item", RAW_ITEM).alias("i")).where("i.number is not null")
        flat = raw.select(
            "i.number", "i.title", "i.body", F.filter("i.labels.name", lambda x: F.coalesce(x, F.lit("")) != "").alias("labels"), "i.state", "i.created_at", "i.updated_at", "i.closed_at", "i.html_url",
            (F.col("pr_feed") | F.col("i.pull_request").isNotNull()).alias("is_pr"), F.col("i.pull_request.merged").alias("merged"), F.col("i.pull_request.merged_at").alias("merged_at"),
        )
        return flat.groupBy("is_pr", "number").agg(F.max_by(F.struct(*flat.columns), F.struct("updated_at", F.sha2(F.coalesce("body", F.lit("")), 256))).alias("r")).select("r.*")

    def canonicalize(self, spark: SparkSession) -> DataFrame:
        items = self.items(recorded(spark, self.path))
        comments = spark.createDataFrame([], "number bigint, position bigint, login string, created_at string, body string")
        return canonical_documents(items, comments, self.repo, self.component, self.specs)
