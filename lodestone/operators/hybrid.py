"""Hits of vectors and full text merged, filtered, weighted by confidence, ordered and cut."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import confidence as weights
from ..functions.versions import version


def merged(vector_hits: DataFrame, text_hits: DataFrame, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """keys, sim (the higher one), src (vector, fts or both) and both places, of hits (keys, sim, place)."""
    v = vector_hits.select(*keys, F.col("sim").alias("v_sim"), F.col("place").alias("v_place"))
    t = text_hits.select(*keys, F.col("sim").alias("f_sim"), F.col("place").alias("f_place"))
    src = F.when(F.col("f_sim").isNull(), "vector").when(F.col("v_sim").isNull(), "fts").otherwise("both")
    return v.join(t, list(keys), "full").select(*keys, F.greatest("v_sim", "f_sim").alias("sim"), src.alias("src"), "v_place", "f_place")


def filtered(docs: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Equality on status, source_type and component; creation as text between bounds, null before all."""
    for k, v in filters.items():
        created = F.coalesce(F.col("created_at").cast("string"), F.lit(""))
        docs = docs.where(created >= v if k == "min_created" else created <= v if k == "max_created" else F.col(k) == v)
    return docs


def resolved(status: Column, resolved_at: Column) -> Column:
    return F.coalesce(status.isin("closed", "merged") & resolved_at.isNotNull(), F.lit(False))


def weighted(hits: DataFrame, now: Column, target: Column, c: weights.Confidence = weights.DEFAULT) -> DataFrame:
    """``hits`` (sim and a document's columns) with confidence, final and resolved. ``target`` is a version as text."""
    w_time = weights.time_weight(F.col("created_at").try_cast("timestamp"), F.col("resolved_at").try_cast("timestamp"), now, c)
    w_version = weights.version_weight(version(F.col("version_min")), version(F.col("version_max")), version(target), c)
    w_source = weights.reliability(F.col("source_type"), F.col("status"), F.col("resolved_at"), F.col("kind"), F.col("verification"), c=c)
    scored = hits.withColumn("confidence", weights.confidence(w_time, w_version, w_source, c))
    return scored.withColumn("final", weights.final_score(F.col("sim"), F.col("confidence"), c)).withColumn("resolved", resolved(F.col("status"), F.col("resolved_at")))


def ordered(hits: DataFrame, key: str, doc: str = "doc_id", least_resolved: float = 0.5, limit: int = 10, tie: str = "chunk_id", digits: int | None = 9) -> DataFrame:
    """The best chunk of each document and its place, ``limit`` documents for each query (``key``).

    Where resolved hits exist but none is similar enough (to four decimals), unresolved ones come first. Scores equal to
    ``digits`` digits (None: exactly equal ones) are ordered by their places on either side.
    """
    best = hits.where("resolved").groupBy(key).agg(F.max(F.round("sim", 4)).alias("_best"))
    late = F.coalesce(F.col("_best") < least_resolved, F.lit(False)) & F.col("resolved")
    order = [late.cast("int"), F.col("final").desc() if digits is None else F.desc(F.round("final", digits)), F.col("v_place").asc_nulls_last(), F.col("f_place").asc_nulls_last(), F.col(tie)]
    joined = hits.join(best, key, "left")
    one = joined.withColumn("_n", F.row_number().over(Window.partitionBy(key, doc).orderBy(*order))).where("_n = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= limit).drop("_n", "_best")
