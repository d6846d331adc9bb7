"""Incremental ingestion: what of a batch is new, changed in content, changed in other fields, or the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(columns: Sequence[str]) -> Column:
    """Of columns as text, parted by a character that texts don't have; nulls differ from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def hashed(docs: DataFrame, embed: Sequence[str], every: Sequence[str]) -> DataFrame:
    """``docs`` with embed_hash (what vectors are made of) and meta_hash (all fields)."""
    return docs.withColumn("embed_hash", content_hash(embed)).withColumn("meta_hash", content_hash(every))


def plan(incoming: DataFrame, stored: DataFrame, key: str = "source_id") -> DataFrame:
    """``incoming`` (hashed) with action: embed, refresh or skip. A stored row without an embed_hash is known by its meta_hash."""
    old = stored.select(F.col(key), F.col("embed_hash").alias("_e"), F.col("meta_hash").alias("_m"), F.lit(True).alias("_there"))
    joined = incoming.join(old, key, "left")
    same = F.coalesce(F.col("_e"), F.when(F.col("_m") == F.col("meta_hash"), F.col("embed_hash"))) == F.col("embed_hash")
    action = F.when(F.col("_there").isNull() | ~F.coalesce(same, F.lit(False)), "embed").when(F.col("_m") == F.col("meta_hash"), "skip").otherwise("refresh")
    return joined.withColumn("action", action).drop("_e", "_m", "_there")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "source_id") -> DataFrame:
    """Stored rows whose keys don't come in, and the incoming ones."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def replace_chunks(chunks: DataFrame, docs: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks without those of the re-chunked documents ``docs``, and the new ones; a document that became empty keeps none."""
    return chunks.join(docs.select(key), key, "left_anti").unionByName(new)
