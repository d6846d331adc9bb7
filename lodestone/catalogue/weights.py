"""Confidence weights over grids of dates, versions and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence as c
from ..functions.versions import version, version_distance
from .registry import registry, table

QUERIES, ORACLES, query = registry()
NOW = "2026-03-01 00:00:00"
_DAYS = "greatest(0, (epoch_us(TIMESTAMP '2026-03-01') - epoch_us({})) / 86400e6)"


def _part_versions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    v = lambda a, b, p: F.concat_ws(".", F.lit("0"), (F.col("p_partkey") % a).cast("string"), ((F.col("p_partkey") + b) % p).cast("string"))
    return part.select(
        "p_partkey", F.when(F.col("p_partkey") % 5 != 0, v(7, 0, 4)).alias("low"), F.when(F.col("p_partkey") % 3 != 0, F.concat_ws(".", F.lit("0"), (F.col("p_partkey") % 7 + 1).cast("string"), F.lit("0"))).alias("high"), v(11, 2, 6).alias("target")
    )


@query(f"SELECT o_orderkey, round(0.15 + 0.85 * pow(2.0, -{_DAYS.format('o_orderdate')} / 365), 6) AS weight FROM orders")
def time_weight_curve(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.round(c.time_weight(F.col("o_orderdate").cast("timestamp"), F.lit(None).cast("timestamp"), F.lit(NOW).cast("timestamp")), 6).alias("weight"))


@query(
    """
WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 END AS lm, p_partkey % 4 AS lp, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 7 + 1 END AS hm,
  p_partkey % 11 AS tm, (p_partkey + 2) % 6 AS tp FROM part)
SELECT p_partkey, round(CASE WHEN lm IS NULL AND hm IS NULL THEN 0.5
  WHEN lm IS NOT NULL AND (tm < lm OR tm = lm AND tp < lp) THEN pow(2.0, -(abs(tm - lm) + 0.1 * abs(tp - lp)) / 1.5)
  WHEN hm IS NOT NULL AND (tm > hm OR tm = hm AND tp > 0) THEN pow(2.0, -(abs(tm - hm) + 0.1 * tp) / 1.5) ELSE 1.0 END, 6) AS weight FROM v"""
)
def version_weight_grid(spark, sf_dir):
    v = lambda n: version(F.col(n))
    return _part_versions(spark, sf_dir).select("p_partkey", F.round(c.version_weight(v("low"), v("high"), v("target")), 6).alias("weight"))


@query("SELECT p_partkey, round(abs(p_partkey % 11 - 3) + 0.1 * abs((p_partkey + 2) % 6 - 5) + 10, 6) AS distance FROM part")
def version_distances(spark, sf_dir):
    return _part_versions(spark, sf_dir).select("p_partkey", F.round(version_distance(version(F.col("target")), version(F.lit("v1.3.5"))), 6).alias("distance"))


def _sources(spark, sf_dir):
    pick = lambda key, names: F.get(F.array(*[F.lit(x) for x in names]), key.cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", pick(F.col("p_partkey") % 7, ("official_doc", "wiki", "discussion", "github_issue", "github_pr", "release_note", "other")).alias("source_type"),
        pick(F.floor(F.col("p_partkey") / 7) % 3, ("open", "closed", "merged")).alias("status"), F.when(F.col("p_partkey") % 2 == 0, F.lit(NOW).cast("timestamp")).alias("resolved"),
        pick(F.floor(F.col("p_partkey") / 21) % 4, ("bug", "doc", "feature", "other")).alias("kind"), pick(F.floor(F.col("p_partkey") / 84) % 4, ("expert", "tested", "unverified", "")).alias("verification"),
    )


_RELIABILITY = """
s AS (SELECT p_partkey, p_partkey % 7 AS t, p_partkey // 7 % 3 AS st, p_partkey // 21 % 4 AS k, p_partkey // 84 % 4 AS ver FROM part),
b AS (SELECT *, CASE WHEN t IN (0, 5) THEN 0.85 WHEN t = 1 THEN 0.7 WHEN t = 2 THEN 0.5 WHEN t IN (3, 4) THEN
    CASE WHEN st = 2 THEN 0.9 WHEN st = 1 AND p_partkey % 2 = 0 THEN 0.6 ELSE 0.4 END * CASE k WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 ELSE 1.0 END ELSE 0.4 END AS base FROM s),
rel AS (SELECT p_partkey, greatest(base, CASE ver WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 WHEN 2 THEN 0.5 ELSE 0 END) AS w FROM b)"""


@query(f"WITH {_RELIABILITY.lstrip()} SELECT p_partkey, round(w, 6)::DOUBLE AS weight FROM rel")
def reliability_matrix(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return s.select("p_partkey", F.round(c.reliability(*[F.col(x) for x in ("source_type", "status", "resolved", "kind", "verification")]), 6).alias("weight"))


@query(f"WITH {_RELIABILITY.lstrip()} SELECT p_partkey, round(pow((p_partkey % 100) / 100.0, 0.6) * pow(least(1.0, 0.6 * ((p_partkey % 13) / 13.0) + 0.4 * w::DOUBLE), 0.4), 6) AS final FROM rel")
def confidence_blend(spark, sf_dir):
    s = _sources(spark, sf_dir)
    w = c.reliability(*[F.col(x) for x in ("source_type", "status", "resolved", "kind", "verification")])
    conf = c.confidence(F.lit(1.0), (F.col("p_partkey") % 13) / 13.0, w)
    return s.select("p_partkey", F.round(c.final_score((F.col("p_partkey") % 100) / 100.0, conf), 6).alias("final"))
