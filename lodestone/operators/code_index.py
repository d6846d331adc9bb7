"""The symbols and lines of source trees, stored by repository and version: a version is added or replaced alone, and a search
of some versions reads theirs only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import code_symbols, source_lines
from .code import EXCLUDED, indexed_sources, two_stage

#: Fixed value: the kinds of files whose symbols are indexed.
EXTENSIONS = (".py", ".cpp", ".hpp", ".h", ".cc", ".cxx")
SYMBOLS = "symbol string, path string, line int, snippet string, repo string, version string"
LINES = "path string, line int, text string, repo string, version string"


class CodeIndex:
    """Two tables under ``path``, partitioned by repo and version; in each partition symbols are sorted, lines by file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, sources: DataFrame, folders: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS, excluded: Sequence[str] = EXCLUDED) -> None:
        """Indexes whole versions (repo, version, path, content); versions that are there are replaced, others stay untouched.

        A version of which no file is indexed is known all the same, and has no rows. Rows without a repo or version are left out.
        """
        known = sources.where("repo is not null and version is not null")
        every = known.select("repo", "version").distinct()
        files = indexed_sources(known, folders, extensions, excluded).select(F.struct("repo", "version").alias("version"), "path", "content")
        self._write(code_symbols(files), every, "symbols", SYMBOLS, ("symbol", "path", "line"))
        self._write(source_lines(files), every, "lines", LINES, ("path", "line"))

    def _write(self, rows: DataFrame, every: DataFrame, table: str, schema: str, order: Sequence[str]) -> None:
        names = [c.split()[0] for c in schema.split(", ")]
        flat = rows.withColumns({"repo": F.col("version.repo"), "version": F.col("version.version")}).select(*names)
        # a row without a path says that the version is known: its partition is replaced even if nothing else is in it
        marked = flat.unionByName(every, allowMissingColumns=True)
        dealt = marked.repartition("repo", "version", F.pmod(F.xxhash64("path"), F.lit(8))).sortWithinPartitions("repo", "version", *order)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "version").parquet(f"{self.path}/{table}")

    def _read(self, table: str, schema: str, repo: str | None, versions: Sequence[str]) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")  # with types: a version is no number
        rows = rows if repo is None else rows.where(F.col("repo") == repo)
        return rows.where(F.col("version").isin(*versions)) if versions else rows

    def symbols(self, repo: str | None = None, versions: Sequence[str] = ()) -> DataFrame:
        """repo, version, symbol, path, line, snippet; of one repository and some versions if they are named."""
        return self._read("symbols", SYMBOLS, repo, versions).where("path is not null")

    def lines(self, repo: str | None = None, versions: Sequence[str] = ()) -> DataFrame:
        """repo, version, path, line, text of all indexed files."""
        return self._read("lines", LINES, repo, versions).where("path is not null")

    def versions(self, repo: str | None = None) -> DataFrame:
        """repo, version and the number of indexed files."""
        rows = self._read("lines", LINES, repo, ())
        return rows.groupBy("repo", "version").agg(F.count_distinct("path").alias("files"))

    def search(self, name: str, repo: str, versions: Sequence[str] = (), limit: int = 50, per_version: bool = False) -> DataFrame:
        """``two_stage`` over one repository: a symbol's rows, or if it has none, the lines that hold the word."""
        return two_stage(self.symbols(repo, versions), self.lines(repo, versions), name, limit, per_version)
