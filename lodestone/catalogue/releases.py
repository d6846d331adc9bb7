"""Release calendars, as-of joins, and the companion matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, versions
from ..operators import asof, companion
from ..plans.search import version_kind
from .registry import registry, table

QUERIES, ORACLES, query = registry()


def _calendar(spark, sf_dir):
    """The first days of the months in which orders were made, as releases."""
    months = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp").alias("date")).distinct()
    return months.select(F.lit("r").alias("repo"), F.concat(F.lit("v"), F.date_format("date", "yyyy.M")).alias("tag"), "date")


_CAL = "cal AS (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS date, 'v' || year(o_orderdate) || '.' || month(o_orderdate) AS tag FROM orders)"
_LINE = "l_orderkey, l_linenumber"


@query(f"WITH {_CAL} SELECT {_LINE}, tag FROM lineitem ASOF LEFT JOIN cal ON l_shipdate >= cal.date")
def asof_backward_release(spark, sf_dir):
    """The last release before each shipment."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("at"), F.lit("r").alias("repo"))
    return asof.latest_before(rows, _calendar(spark, sf_dir), "at", ["repo"]).select("l_orderkey", "l_linenumber", "tag")


@query(f"WITH {_CAL} SELECT {_LINE}, tag FROM lineitem ASOF LEFT JOIN cal ON date_trunc('minute', l_shipdate::TIMESTAMP) <= cal.date")
def asof_forward_release(spark, sf_dir):
    """The first release after each shipment; none for the latest ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("at"), F.lit("r").alias("repo"))
    return asof.first_after(rows, _calendar(spark, sf_dir), "at", ["repo"]).select("l_orderkey", "l_linenumber", "tag")


@query(f"WITH {_CAL} SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN '0.1.0' END, tag) AS version_max FROM orders ASOF LEFT JOIN cal ON o_orderdate >= cal.date")
def span_enrichment(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("resolved_at"), F.lit("r").alias("repo"), F.when(F.col("o_orderkey") % 4 == 0, "0.1.0").alias("version_max"))
    return asof.enriched_span(rows, _calendar(spark, sf_dir), ["repo"]).select("o_orderkey", "version_max")


_TAGS = "tags AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'v' ELSE '' END || '0.' || o_orderkey % 9 || CASE o_orderkey % 5 WHEN 0 THEN 'rc1' WHEN 1 THEN '.dev2' WHEN 2 THEN '.post1' ELSE '' END AS tag FROM orders)"
_KIND = "CASE WHEN lower(tag) LIKE '%rc%' THEN 'rc' WHEN regexp_matches(lower(tag), 'alpha|beta|dev|pre|post') THEN 'pre' ELSE 'release' END"


def _tags(spark, sf_dir):
    suffix = F.when(F.col("o_orderkey") % 5 == 0, "rc1").when(F.col("o_orderkey") % 5 == 1, ".dev2").when(F.col("o_orderkey") % 5 == 2, ".post1").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "v").otherwise(""), F.lit("0."), (F.col("o_orderkey") % 9).cast("string"), suffix).alias("tag"))


@query(f"WITH {_TAGS} SELECT {_KIND} AS kind, count(*) AS n FROM tags GROUP BY 1")
def calendar_kind_histogram(spark, sf_dir):
    return _tags(spark, sf_dir).groupBy(versions.version_kind(F.col("tag")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""
WITH {_TAGS}, cal AS (SELECT DISTINCT tag, {_KIND} AS kind FROM tags WHERE o_orderkey % 2 = 0), asked AS (SELECT DISTINCT tag FROM tags)
SELECT a.tag, coalesce(e.kind, p.kind, 'unknown') AS kind, CASE WHEN e.kind IS NOT NULL THEN 'exact' WHEN p.kind IS NOT NULL THEN 'plain' ELSE 'none' END AS match
FROM asked a LEFT JOIN cal e USING (tag) LEFT JOIN (SELECT regexp_replace(tag, '^[vV]+', '') AS norm, min(kind) AS kind FROM cal GROUP BY 1) p ON p.norm = regexp_replace(a.tag, '^[vV]+', '')"""
)
def version_kind_lookup(spark, sf_dir):
    tags = _tags(spark, sf_dir)
    calendar = tags.where("o_orderkey % 2 = 0").select("tag", versions.version_kind(F.col("tag")).alias("kind")).distinct()
    return version_kind(tags.select("tag").distinct(), calendar)


@query(f"WITH {_TAGS} SELECT tag, dense_rank() OVER (ORDER BY try_cast(split_part(regexp_replace(tag, '^[vV]+', ''), '.', 1) AS INT), coalesce(try_cast(split_part(regexp_replace(tag, '^[vV]+', ''), '.', 2) AS INT), 0), len(string_split(tag, '.')), tag)::INT AS place FROM (SELECT DISTINCT tag FROM tags)")
def versions_in_order(spark, sf_dir):
    """All tags, ordered by their parts as numbers."""
    from pyspark.sql import Window

    w = Window.orderBy(versions.version_order(F.col("tag")), "tag")  # one row for each release
    return _tags(spark, sf_dir).select("tag").distinct().select("tag", F.dense_rank().over(w).alias("place"))


def _matrix(spark, sf_dir):
    """Suppliers as rows of a matrix of three components."""
    v = lambda a, b: F.concat(F.lit("0."), (F.col("s_suppkey") % a).cast("string"), F.lit("."), (F.col("s_suppkey") % b).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), v(17, 3).alias("engine"), v(11, 2).alias("driver"), F.when(F.col("s_suppkey") % 4 != 0, v(5, 1)).otherwise("").alias("library"))


_MATRIX = """
m AS (SELECT s_suppkey AS row_id, '0.' || s_suppkey % 17 || '.' || s_suppkey % 3 AS engine, '0.' || s_suppkey % 11 || '.' || s_suppkey % 2 AS driver,
  CASE WHEN s_suppkey % 4 <> 0 THEN '0.' || s_suppkey % 5 || '.0' ELSE '' END AS library FROM supplier),
q AS (SELECT n_nationkey AS query_id, 'v0.' || n_nationkey || '.' || n_nationkey % 3 AS version FROM nation),
ex AS (SELECT query_id, row_id FROM q JOIN m ON regexp_replace(q.version, '^[vV]+', '') = m.engine),
nr AS (SELECT query_id, row_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS place FROM (
  SELECT query_id, row_id, abs(split_part(version, '.', 2)::INT - split_part(engine, '.', 2)::INT) + 0.1 * abs(split_part(version, '.', 3)::INT - split_part(engine, '.', 3)::INT) AS distance FROM q, m))"""
COMPONENTS = ("engine", "driver", "library")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.lit("engine").alias("component"), F.concat(F.lit("v0."), F.col("n_nationkey").cast("string"), F.lit("."), (F.col("n_nationkey") % 3).cast("string")).alias("version"))


@query(f"WITH {_MATRIX.lstrip()} SELECT * FROM ex")
def companion_exact(spark, sf_dir):
    return companion.exact(_asked(spark, sf_dir), companion.unpivoted(_matrix(spark, sf_dir), COMPONENTS))


@query(f"WITH {_MATRIX.lstrip()} SELECT query_id, row_id, round(distance, 6)::DOUBLE AS distance, place::INT AS place FROM nr WHERE place <= 3")
def companion_nearest3(spark, sf_dir):
    return companion.nearest(_asked(spark, sf_dir), companion.unpivoted(_matrix(spark, sf_dir), COMPONENTS)).withColumn("distance", F.round("distance", 6))


@query(
    f"""
WITH {_MATRIX.lstrip()}, r AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY row_id) AS place FROM ex
  UNION ALL SELECT query_id, row_id, place FROM nr WHERE place <= 3 AND query_id NOT IN (SELECT query_id FROM ex)),
c AS (SELECT query_id, place, 'driver' AS component, driver AS version FROM r JOIN m USING (row_id) UNION ALL SELECT query_id, place, 'library', library FROM r JOIN m USING (row_id) WHERE library <> '')
SELECT query_id, component, list(version ORDER BY place) AS versions FROM (SELECT query_id, component, version, min(place) AS place FROM c GROUP BY ALL) GROUP BY ALL"""
)
def companion_expand(spark, sf_dir):
    return companion.expand(_asked(spark, sf_dir), companion.unpivoted(_matrix(spark, sf_dir), COMPONENTS))


@query(
    """
WITH d AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS comp, o_orderkey % 8 AS low FROM orders), k AS (SELECT comp, n AS place, (n * 3 + comp) % 10 AS minor FROM range(4) a(n), range(3) b(comp)),
s AS (SELECT doc_id, place, minor, CASE WHEN minor < low THEN pow(2.0, -(low - minor) / 1.5) WHEN minor > low + 2 THEN pow(2.0, -(minor - low - 2) / 1.5) ELSE 1.0 END AS w FROM d JOIN k USING (comp))
SELECT doc_id, '0.' || minor || '.0' AS version_ref, round(w, 6) AS w FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, place) = 1"""
)
def effective_version_argmax(spark, sf_dir):
    """Each order as a document with a span of three versions, against four candidates of its component."""
    key = F.col("o_orderkey")
    at = lambda m: versions.version(F.concat(F.lit("0."), m.cast("string"), F.lit(".0")))
    docs = table(spark, sf_dir, "orders").select(key.alias("doc_id"), (key % 3).alias("component"), at(key % 8).alias("low"), at(key % 8 + 2).alias("high"))
    rows = [(c, n, f"0.{(n * 3 + c) % 10}.0") for n in range(4) for c in range(3)]
    candidates = spark.createDataFrame(rows, "component bigint, place int, version string")
    return companion.effective_version(docs, candidates).withColumn("w", F.round("w", 6))


def _sides(spark, sf_dir):
    part = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("key")
    auto = part.where("s_suppkey % 5 <> 0").select(key, F.concat(F.lit("a"), (F.col("s_suppkey") % 7).cast("string")).alias("engine"), F.when(F.col("s_suppkey") % 2 == 0, "d1").otherwise("").alias("driver"), F.lit("auto").alias("notes"))
    manual = part.where("s_suppkey % 3 = 0").select(key, F.when(F.col("s_suppkey") % 2 == 0, "m").otherwise("").alias("engine"), F.lit("").alias("driver"), F.lit("").alias("notes"), F.when(F.col("s_suppkey") % 9 == 0, "l2").otherwise("").alias("library"))
    return auto, manual


_MERGED = """
a AS (SELECT 'v' || s_suppkey AS key, 'a' || s_suppkey % 7 AS engine, CASE WHEN s_suppkey % 2 = 0 THEN 'd1' ELSE '' END AS driver, 'auto' AS notes FROM supplier WHERE s_suppkey % 5 <> 0),
h AS (SELECT 'v' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'm' ELSE '' END AS engine, '' AS driver, '' AS notes, CASE WHEN s_suppkey % 9 = 0 THEN 'l2' ELSE '' END AS library FROM supplier WHERE s_suppkey % 3 = 0),
merged AS (SELECT coalesce(a.key, h.key) AS key, coalesce(nullif(h.engine, ''), a.engine, '') AS engine, coalesce(nullif(h.driver, ''), a.driver, '') AS driver, coalesce(nullif(h.notes, ''), a.notes, '') AS notes, coalesce(h.library, '') AS library FROM a FULL JOIN h ON a.key = h.key)"""


def _merge(spark, sf_dir):
    return companion.merged_matrix(*_sides(spark, sf_dir), "key", ("engine", "driver", "notes"), ("library",))


@query(f"WITH {_MERGED.lstrip()} SELECT * FROM merged")
def matrix_merge_manual(spark, sf_dir):
    return _merge(spark, sf_dir)


@query(f"WITH {_MERGED.lstrip()}, g AS (SELECT key, list_filter([CASE WHEN engine = '' THEN 'engine' END, CASE WHEN driver = '' THEN 'driver' END, CASE WHEN library = '' THEN 'library' END], lambda x: x IS NOT NULL) AS missing FROM merged) SELECT * FROM g WHERE len(missing) > 0")
def gap_report(spark, sf_dir):
    return companion.gaps(_merge(spark, sf_dir), "key", COMPONENTS)


@query(f"WITH {_MERGED.lstrip()} SELECT count(*) FILTER (engine <> '') AS engine, count(*) FILTER (driver <> '') AS driver, count(*) FILTER (library <> '') AS library FROM merged")
def filled_counts(spark, sf_dir):
    return companion.filled_counts(_merge(spark, sf_dir), COMPONENTS)


@query(
    """
WITH o AS (SELECT o_orderstatus AS version, 'priority' AS component, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderstatus, 'customer', 'c' || o_custkey % 50 FROM orders),
n AS (SELECT *, count(*) AS n FROM o GROUP BY ALL)
SELECT version, component, value, n FROM n QUALIFY row_number() OVER (PARTITION BY version, component ORDER BY n DESC, value) = 1"""
)
def mode_by_version(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.select(F.col("o_orderstatus").alias("version"), F.lit("priority").alias("component"), F.col("o_orderpriority").alias("value"))
    return companion.modes(a.unionByName(orders.select(F.col("o_orderstatus").alias("version"), F.lit("customer").alias("component"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("value"))))


_IMAGES = "images AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'nightly-main' WHEN 1 THEN 'releases-v0.' || p_partkey % 9 || '.0' WHEN 2 THEN 'latest' WHEN 3 THEN 'v0.' || p_partkey % 9 || '.0-a3-openeuler' WHEN 4 THEN 'v0.' || p_partkey % 9 || '.0' ELSE 'x_dev_' || p_partkey % 9 END AS tag FROM part)"
MOVING = parsing.MOVING


def _images(spark, sf_dir):
    key, minor = F.col("p_partkey"), (F.col("p_partkey") % 9).cast("string")
    tag = F.when(key % 6 == 0, "nightly-main").when(key % 6 == 1, F.concat(F.lit("releases-v0."), minor, F.lit(".0"))).when(key % 6 == 2, "latest").when(key % 6 == 3, F.concat(F.lit("v0."), minor, F.lit(".0-a3-openeuler"))).when(key % 6 == 4, F.concat(F.lit("v0."), minor, F.lit(".0"))).otherwise(F.concat(F.lit("x_dev_"), minor))
    return table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"))


@query(f"WITH {_IMAGES} SELECT p_partkey, tag FROM images WHERE NOT regexp_matches(tag, '{MOVING}')")
def managed_filter(spark, sf_dir):
    return _images(spark, sf_dir).where(parsing.is_managed(F.col("tag")))


@query(
    f"""WITH {_IMAGES} SELECT CASE WHEN regexp_matches(lower(tag), 'nightly|ntightly|daily') THEN 'nightly' WHEN starts_with(lower(tag), 'releases') OR contains(lower(tag), '-releases') THEN 'branch'
  WHEN lower(tag) IN ('latest', 'develop', 'master') OR starts_with(lower(tag), 'main') THEN 'trunk' WHEN starts_with(lower(tag), 'dev') OR regexp_matches(lower(tag), '[-_]dev') THEN 'dev' ELSE 'other' END AS category, count(*) AS n
FROM images WHERE regexp_matches(tag, '{MOVING}') GROUP BY 1"""
)
def excluded_categories(spark, sf_dir):
    moving = _images(spark, sf_dir).where(~parsing.is_managed(F.col("tag")))
    return moving.groupBy(parsing.moving_category(F.col("tag")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_IMAGES}, b AS (SELECT DISTINCT regexp_replace(tag, '{versions.PLATFORM}', '') AS base, tag FROM images) SELECT base, coalesce(max(CASE WHEN tag = base THEN tag END), min(tag)) AS tag, count(*) AS n FROM b GROUP BY base")
def base_version_groups(spark, sf_dir):
    tags = _images(spark, sf_dir).select(versions.base_version(F.col("tag")).alias("base"), "tag").distinct()
    return companion.representatives(tags)
