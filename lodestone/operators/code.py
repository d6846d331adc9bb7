"""Search in versioned source trees: symbols first, else lines."""

from __future__ import annotations

from collections.abc import Sequence

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fulltext import top_per

#: Folders that are left out.
EXCLUDED = ("tests", "third_party", "docs", "examples", "benchmarks")


def indexed_sources(sources: DataFrame, folders: Sequence[str] = (), extensions: Sequence[str] = (".py", ".cpp"), excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """Source files of some folders (all if none is named), by extension, outside excluded folders."""
    out = sources.where(F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in extensions) + ")$"))
    out = out.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*excluded)))
    return out.where(F.substring_index("path", "/", 1).isin(*folders)) if folders else out


def grep(lines: DataFrame, keyword: str, limit: int = 50, per_version: bool = False, path: str = "") -> DataFrame:
    """version, path, line, text of lines (of such columns) that hold a keyword in any case; ``limit`` in all or per version."""
    hits = lines.where(F.contains(F.lower("text"), F.lit(keyword.lower())) & F.contains("path", F.lit(path)))
    if per_version:
        return top_per(hits, "version", [F.col("path"), F.col("line")], limit).drop("place")
    return hits.orderBy("version", "path", "line").limit(limit)


def lookup(symbols: DataFrame, name: str, versions: Sequence[str] = ()) -> DataFrame:
    """Rows of one symbol, in any case."""
    hits = symbols.where(F.col("symbol") == name.lower())
    return hits.where(F.col("version").isin(*versions)) if versions else hits


def two_stage(symbols: DataFrame, lines: DataFrame, name: str, limit: int = 50, per_version: bool = False) -> DataFrame:
    """version, path, line, text, stage: the symbol's rows, or if it has none, the lines that hold the word. One plan.

    With ``per_version`` lines are searched at once, ``limit`` of each version: symbols don't tell versions apart.
    """
    if per_version:
        hits = grep(lines, name, limit, True).select("version", "path", "line", "text", F.lit("line").alias("stage"))
        return hits.orderBy("version", "path", "line")
    exact = lookup(symbols, name).select("version", "path", "line", F.col("snippet").alias("text"), F.lit("symbol").alias("stage"))
    any_exact = exact.agg((F.count("*") > 0).alias("any"))
    loose = grep(lines, name, limit).select("version", "path", "line", "text", F.lit("line").alias("stage"))
    rest = loose.join(F.broadcast(any_exact)).where("not any").drop("any")  # one row
    return exact.unionByName(rest).orderBy("version", "path", "line").limit(limit)


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, text, change: lines that only one of two versions (path, text) of a file has."""
    a, b = old.select("path", "text").distinct(), new.select("path", "text").distinct()
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


def unified_diff(files: DataFrame) -> DataFrame:
    """path, diff of files (path, old, new); equal ones have an empty diff."""

    @F.pandas_udf("string")
    def diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((o or "").splitlines(True), (n or "").splitlines(True), f"a/{p}", f"b/{p}")) for p, o, n in zip(path, old, new, strict=True)])

    return files.select("path", diff("path", "old", "new").alias("diff"))
