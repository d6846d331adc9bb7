"""Sinks and readers of canonical documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.canonical import new_rows
from .schema import CANONICAL


def unique(docs: DataFrame) -> DataFrame:
    """One document of each source_id: the first that came in, by a column ``ingest_order`` if there is one .

    Tables have no order of their own: without that column, or where it is equal, the earliest created counts, then the least
    text, so that a rerun keeps the same.
    """
    came = [F.col("ingest_order").asc_nulls_last()] if "ingest_order" in docs.columns else []
    came.append(F.col("created_at").asc_nulls_last())
    w = Window.partitionBy("source_id").orderBy(*came, F.sha2(F.coalesce("body", F.lit("")), 256))
    return docs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "ingest_order")


def overwrite(docs: DataFrame, path: str) -> None:
    unique(docs).write.mode("overwrite").parquet(path)


def append(docs: DataFrame, path: str) -> None:
    """Adds ids that aren't there; documents that are there stay as they are."""
    present = docs.sparkSession.read.parquet(path)
    new_rows(unique(docs), present, "source_id").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANONICAL).parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents as JSON lines; lines that aren't documents are left out."""
    schema = StructType([*CANONICAL, StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and source_id is not null").drop("_corrupt")


def export_json(docs: DataFrame, path: str) -> None:
    """JSON lines; line separators inside a text are escaped, so a document is a line for every reader."""
    line = F.to_json(F.struct("*"))
    for ch in ("\u2028", "\u2029", "\u0085"):
        line = F.replace(line, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    docs.select(line.alias("value")).write.mode("overwrite").text(path)
