"""A store of chunk vectors as Parquet: rows are put into buckets by a hash of their document, and a write makes new files
for the buckets that it touches only. A manifest names the files of each bucket; the last complete manifest counts.

A row has chunk_id, doc_id, embedding and meta (a map). Ids are unique: what comes in takes the place of what is there.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import Buckets
from .stored import stored

SCHEMA = "chunk_id string, doc_id string, embedding array<float>, meta map<string,string>"


class ReadOnly(RuntimeError):
    """A write to a store that is open for reading."""


class VectorStore:
    """``read_only`` stores refuse every write."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, buckets: int = 64):
        self.spark, self.read_only = spark, read_only
        self.files = Buckets(spark, path, SCHEMA, "doc_id", buckets)

    def read(self) -> DataFrame:
        return self.files.read()

    def _write(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        self._refuse()
        self.files.rewrite(touched, change)

    def _refuse(self) -> None:
        if self.read_only:
            raise ReadOnly("the vector store is open for reading only")

    def _once(self, rows: DataFrame) -> DataFrame:
        """Rows with one of each chunk_id (the greatest counts), written: they are looked at several times."""
        one = rows.groupBy("chunk_id").agg(F.max_by(F.struct("doc_id", "embedding", "meta"), F.struct("doc_id", F.to_json("meta"), "embedding")).alias("r"))
        return stored(one.select("chunk_id", "r.*").select("chunk_id", "doc_id", "embedding", "meta"), "vectors")

    def _put(self, rows: DataFrame, docs: DataFrame | None) -> None:
        """``rows`` take the place of all chunks of ``docs`` and of the chunks that have their ids, in whatever document."""
        elsewhere = self.read().join(rows.select("chunk_id"), "chunk_id", "left_semi").select("doc_id")
        touched = stored((elsewhere if docs is None else elsewhere.union(docs.select("doc_id"))).union(rows.select("doc_id")).distinct(), "touched")

        def change(old: DataFrame) -> DataFrame:
            kept = old.join(rows.select("chunk_id"), "chunk_id", "left_anti")
            kept = kept if docs is None else kept.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")
            return kept.select(rows.columns).unionByName(rows)

        self._write(touched, change)

    def add(self, rows: DataFrame) -> None:
        """Rows of new chunks, or new rows of known ones, which may have moved to another document; of rows with one chunk_id in a
        batch the greatest counts.
        """
        self._refuse()
        self._put(self._once(rows), None)

    def replace(self, docs: DataFrame, rows: DataFrame) -> None:
        """The documents ``docs`` (doc_id) and those of ``rows`` have the chunks ``rows`` and no others."""
        self._refuse()
        once = self._once(rows)
        self._put(once, docs.select("doc_id").union(once.select("doc_id")).distinct())

    def delete(self, docs: DataFrame) -> None:
        """All chunks of the documents ``docs`` (doc_id), in one pass however many they are."""
        self._write(docs, lambda old: old.join(docs.select("doc_id").distinct(), "doc_id", "left_anti"))

    def update_meta(self, rows: DataFrame) -> None:
        """New meta of all chunks of documents (doc_id, meta), of several rows of a document the greatest; vectors stay."""
        new = rows.groupBy("doc_id").agg(F.max_by("meta", F.to_json("meta")).alias("_new"))
        self._write(rows, lambda old: old.join(new, "doc_id", "left").withColumn("meta", F.coalesce("_new", "meta")).select(*old.columns))

    def clear(self) -> None:
        self._refuse()
        self.files.clear()

    def count(self) -> int:
        return self.read().count()


def embedded(chunks: DataFrame, provider: Callable | str = "echo", batch: int = 64, dim: int = 256, degrade: bool = False) -> DataFrame:
    """chunk_id, doc_id, embedding, meta of chunks (chunk_id, doc_id, text, and what else goes into meta).

    ``echo`` hashes n-grams into ``dim`` buckets, in Arrow batches. Any other provider is a function of a list of texts to a list of
    vectors; it is called with ``batch`` texts at a time, across documents, in Arrow batches. With ``degrade`` the
    texts of a call that fails are asked for one by one, behind a breaker in each task, and those that fail have no vector
    (null); else a failing call fails the job.
    """
    rest = [c for c in chunks.columns if c not in ("chunk_id", "doc_id", "text")]
    meta = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    plain = chunks.select("chunk_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), meta.alias("meta"))
    if isinstance(provider, str):
        if provider != "echo":
            raise ValueError(f"no such provider: {provider}")
        from .vectors import echo_rows

        return echo_rows(plain, "text", "embedding", dim).select("chunk_id", "doc_id", "embedding", "meta")

    def run(frames):
        ask = Breaker(provider, time.monotonic) if degrade else provider
        for frame in frames:
            texts, out = frame["text"].tolist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                got = ask(some)
                if got is None and len(some) > 1:  # one bad text may fail a batch; while the provider is down the breaker answers
                    got = [x[0] if (x := ask([t])) else None for t in some]
                out += [None] * len(some) if got is None else [None if v is None else list(map(float, v)) for v in got]
            frame["embedding"] = out
            yield frame[["chunk_id", "doc_id", "embedding", "meta"]]

    return plain.mapInPandas(run, SCHEMA)


class Breaker:
    """Keeps from calling a provider that fails: after ``most`` failures in a row it is open for ``seconds``; then one try.

    While it is open, or a call fails, the answer is None, and search goes on with full text alone. ``clock`` gives seconds.
    """

    def __init__(self, call: Callable, clock: Callable[[], float], most: int = 3, seconds: float = 60.0):
        self.call, self.clock, self.most, self.seconds = call, clock, most, seconds
        self.failures, self.until = 0, 0.0

    @property
    def open(self) -> bool:
        return self.failures >= self.most and self.clock() < self.until

    def __call__(self, text):
        """``call`` of a text, or of a list of them."""
        if self.open:
            return None
        try:
            out = self.call(text)
        except Exception:  # noqa: BLE001  whatever the provider raises counts
            self.failures += 1
            if self.failures >= self.most:
                self.until = self.clock() + self.seconds
            return None
        self.failures = 0
        return out
