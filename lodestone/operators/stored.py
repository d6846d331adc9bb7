"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where a local session names none, a folder of this machine's (as in tests).

    On a cluster there is no such folder: machines would write to disks that others can't see. So the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-shared")
    return path.rstrip("/")


#: Tasks for each core, where rows are spread.
TASKS_A_CORE = 4


def spread_out(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores: for small rows that each take long, which Spark would read by the size of their file in few tasks."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


#: Tasks that the rows of one value are dealt out to, when a table is sorted by it.
SPREAD = 64


def stored(df: DataFrame, tag: str, by: str | None = None, spread: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again; sorted within files by a column that queries look up.

    ``spread`` names a column by which the rows of one value are dealt out, so that no task gets all of a frequent one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    keys = [by] if spread is None else [by, F.pmod(F.xxhash64(spread), F.lit(SPREAD))]
    (df.repartition(*keys).sortWithinPartitions(by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
