"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer files lie unless the caller names another folder.
TOKENIZER_DIR = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where a local session leaves it unset, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor never makes more than the current step run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch. Batches of ten thousand long texts would fill a worker's memory.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes; a bound that is lower already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def released(run):
    """A function of batches that gives free memory back when its partition ends: workers live on, with what they hold."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (a long or null) and the text, under fixed names; whatever else the table has can't clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, over an array of uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_chunks(batch, limit: int = 1 << 20):
    """Slices of a record batch with about ``limit`` bytes of its string columns each, a row at least."""
    n, start, size = batch.num_rows, 0, 0
    if not n:
        return
    per_row = np.zeros(n, dtype=np.int64)
    for column in batch.columns:
        if str(column.type) in ("string", "large_string", "binary", "large_binary"):
            per_row += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for i in range(n):
        size += int(per_row[i])
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < n:
        yield batch.slice(start, n - start)


def bitmap(ids: DataFrame, key: str, most_bits: int, hashed: bool = False) -> tuple[np.ndarray, int]:
    """A bitmap of hashed keys and its number of bits: enough for few collisions, ``most_bits`` at most.

    ``hashed`` keys are random bits already.
    """
    slots = min(most_bits, 1 << max(15, 4 + ids.count().bit_length()))
    slot = F.pmod(F.col(key) if hashed else F.xxhash64(key), F.lit(slots))
    parts = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(32767)).alias("b"))
    bits = np.zeros(slots // 8, np.uint8)
    for r in parts.toLocalIterator():
        bits[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    return bits, slots


def _met(bits: np.ndarray, slots) -> np.ndarray:
    s = slots.to_numpy(zero_copy_only=False)
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def packed_texts(docs: DataFrame, ids: DataFrame, key: str, most_bits: int = 1 << 26) -> DataFrame:
    """``key`` and the compressed text (column packed) of the rows whose keys may be among ``ids`` (a column of that name).

    A bitmap of hashed keys tells; it has ``most_bits`` bits at most, whatever the number of keys, and where they fill
    it, it only lets more rows pass. What follows joins a small part of the texts, compressed, instead of all of them.
    """
    small_batches(docs.sparkSession)
    bits, slots = bitmap(ids, key, most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            some = batch.filter(pa.array(_met(shared.value, batch.column(2))))
            yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array([pack(x or b"") for x in some.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=[key, "packed"])

    return docs.where(F.col(key).isNotNull()).select(key, "text", F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot")).mapInArrow(released(run), f"{key} bigint, packed binary")


def without(docs: DataFrame, ids: DataFrame, key: str, most_bits: int = 1 << 26) -> DataFrame:
    """The rows of ``docs`` whose keys are not among ``ids``, all columns kept; rows with a null key stay.

    Rows that the bitmap of ``ids`` clears stay where they are; only the others are joined.
    """
    small_batches(docs.sparkSession)
    bits, slots = bitmap(ids, key, most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    slot, gone = (f"_{uuid.uuid4().hex}" for _ in range(2))  # names that no column of the table has

    def part(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(_met(shared.value, batch.column(batch.num_columns - 1)) == wanted)).select(range(batch.num_columns - 1))

        return docs.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(slots))).mapInArrow(released(run), docs.schema)

    return part(False).unionByName(part(True).join(ids.select(F.col(key).alias(gone)), F.col(key) == F.col(gone), "left_anti"))
