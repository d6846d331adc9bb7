"""Incremental ingestion as a stream of new files: each micro-batch is planned against what is stored and merged in."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators.buckets import Buckets
from ..operators.stored import shared_folder


class Store:
    """A table of documents in buckets by key; a micro-batch makes a new version of the buckets that it touches.

    Which version is the last is read from the folder each time, so a restarted stream goes on where it was. A batch that
    runs again starts from the version before it and writes the same one.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "source_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _files(self) -> Buckets:
        probe = Buckets(self.spark, self.path, "source_id string", self.key, self.buckets)
        first = next(iter(probe._manifest(probe.version()).items()), None)
        probe.schema = None if first is None else self.spark.read.parquet(f"{self.path}/data/v{first[1]}/bucket={first[0]}").schema
        return probe

    def read(self) -> DataFrame | None:
        files = self._files()
        return None if files.schema is None else files.read()

    def merge(self, batch: DataFrame, batch_id: int, key: str, embed: Sequence[str], every: Sequence[str]) -> None:
        """Idempotent. Of equal keys in a batch the last hash counts."""
        incoming = ingest.hashed(batch, embed, every).withColumn("batch", F.lit(batch_id))
        incoming = incoming.groupBy(key).agg(F.max_by(F.struct("*"), "meta_hash").alias("r")).select("r.*")
        files = self._files()
        files.key, files.schema = key, incoming.schema

        def change(stored: DataFrame) -> DataFrame:
            changed = ingest.plan(incoming, stored, key).where("action <> 'skip'").drop("action")
            return ingest.upsert(stored, changed, key)

        files.rewrite(incoming, change, batch_id)


def ingest_stream(spark: SparkSession, files: str, schema, store: Store, checkpoint: str, key: str, embed: Sequence[str], every: Sequence[str], files_per_batch: int = 1):
    """A query that takes in all files that are there and stops."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = files.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in spark.read.schema(schema).parquet(files).inputFiles()] == [name]:  # a single file
        reader, files = reader.option("pathGlobFilter", name), folder
    stream = reader.parquet(files)
    run = lambda batch, batch_id: store.merge(batch, batch_id, key, embed, every)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(spark: SparkSession, path: str, key: str, embed: Sequence[str], every: Sequence[str]) -> DataFrame:
    """The stored rows (key and hashes) after a stream has taken in all files under ``path``."""
    base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    store = Store(spark, f"{base}/store")
    schema = spark.read.parquet(path).schema
    ingest_stream(spark, path, schema, store, f"{base}/checkpoint", key, embed, every).awaitTermination()
    return store.read().select(key, "embed_hash", "meta_hash")
