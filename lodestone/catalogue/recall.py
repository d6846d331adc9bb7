"""Searches of many whole queries at once: nearest vectors, prefixes where a phrase has no hits, and both sides with components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..operators import companion, fulltext, vectors
from ..operators.stored import stored
from ..operators.vector_store import embedded
from ..plans.search import component_search
from .registry import registry, table
from .retrieval import NOW, _tokens, derived_documents, index_of_documents

QUERIES, ORACLES, query = registry()

_PAIR = "greatest(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0.0)"


@query(
    f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_PAIR} AS sim FROM e a, e b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS place FROM s QUALIFY place <= 50"""
)
def vector_topk_each(spark, sf_dir):
    """The fifty rows nearest to each vector whose id is divisible by 20, of all rows."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vectors.nearest_each(rows, queries, 50, "vec_id")
    return got.select("query_id", "id", F.round("sim", 6).alias("sim"), F.col("place").cast("bigint").alias("place"))


_TOKENS = f"""words AS (SELECT doc_id, {_tokens("text")} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM words),
lens AS (SELECT doc_id, len(w) AS dl FROM words), tot AS (SELECT count(*) AS n, avg(dl) AS a FROM lens)"""
_IDF = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END"
_SEARCH = f"""items AS (SELECT item_id AS query_id, {_tokens("text")} AS q FROM benchmark),
parts AS (SELECT query_id, unnest(q) AS token, generate_subscripts(q, 1) AS k, len(q) AS n FROM items),
whole AS (SELECT query_id, doc_id, count(*) AS tf FROM (SELECT query_id, doc_id, pos - k AS s, n FROM parts JOIN tok USING (token) GROUP BY ALL HAVING count(DISTINCT k) = n) GROUP BY ALL),
vocab AS (SELECT token, doc_id, count(*) AS c FROM tok GROUP BY ALL),
heads AS (SELECT DISTINCT token AS head FROM parts WHERE k <= 8 AND query_id NOT IN (SELECT query_id FROM whole)),
met AS (SELECT head, doc_id, sum(c) AS tf FROM heads JOIN vocab ON starts_with(vocab.token, head) GROUP BY ALL),
loose AS (SELECT query_id, k, doc_id, tf FROM parts JOIN met ON head = token WHERE k <= 8 AND query_id NOT IN (SELECT query_id FROM whole)),
every AS (SELECT query_id, 0 AS k, doc_id, tf FROM whole UNION ALL SELECT * FROM loose),
often AS (SELECT query_id, k, count(*) AS df FROM every GROUP BY ALL),
summed AS (SELECT query_id, doc_id, sum({_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS rank FROM every JOIN often USING (query_id, k) JOIN lens USING (doc_id), tot GROUP BY ALL),
fts AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, doc_id) AS f FROM summed QUALIFY f <= 50)"""


@query(f"WITH {_TOKENS}, {_SEARCH} SELECT query_id, doc_id AS chunk_id, f AS place, round(rank, 6) AS rank FROM fts")
def fulltext_search_whole_items(spark, sf_dir):
    """Whole benchmark items as phrases over all documents; of those without a hit the first eight words as prefixes."""
    index, lengths = index_of_documents(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), search_tokens(F.col("text")).alias("tokens"))
    got = fulltext.search(index, lengths, items, 50)
    return got.select("query_id", "chunk_id", F.col("place").cast("bigint").alias("place"), F.round("rank", 6).alias("rank"))


#: Components that the made-up matrix has, and the factor by which each one's minor version follows from the row.
_MATRIX = {"src1": 1, "src2": 2, "src3": 4}
_ECHO = """
texts AS (SELECT doc_id AS id, false AS asked, lower(text) AS t FROM documents UNION ALL SELECT item_id, true, lower(text) FROM benchmark),
low AS (SELECT *, regexp_extract_all(t, '[a-z0-9]+') AS w FROM texts),
pieces AS (SELECT id, asked, substr(t, (b * 200 + 1)::INT, 203) AS p FROM (SELECT id, asked, t, unnest(range(0, length(t) // 200 + 1)) AS b FROM low)),
counts AS (SELECT id, asked, substr(p, i::INT, n) AS g, count(*)::DOUBLE AS w FROM (SELECT id, asked, p, n, unnest(range(1, least(length(p) - n + 1, 200) + 1)) AS i FROM pieces, (VALUES (2), (3), (4)) v(n)) GROUP BY ALL
  UNION ALL SELECT id, asked, g, 2.0 * count(*) FROM (SELECT id, asked, 'w:' || unnest(w) AS g FROM low) GROUP BY ALL
  UNION ALL SELECT id, asked, g, 3.0 * count(*) FROM (SELECT id, asked, 'b:' || w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, asked, w, unnest(range(1, len(w))) AS i FROM low)) GROUP BY ALL),
kinds AS (SELECT g, (('0x' || substr(md5(g), 1, 16))::UBIGINT % 256)::INT AS bucket FROM (SELECT DISTINCT g FROM counts)),
sums AS (SELECT id, asked, bucket, sum(w) AS s FROM counts JOIN kinds USING (g) GROUP BY ALL),
vec AS (SELECT id, asked, bucket, (s / sqrt(sum(s * s) OVER (PARTITION BY id, asked)))::FLOAT::DOUBLE AS x FROM sums),
unit AS (SELECT id, asked, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id, asked)) AS x FROM vec),
near AS (SELECT a.id AS query_id, b.id AS doc_id, sum(a.x * b.x) AS sim FROM unit a JOIN unit b USING (bucket) WHERE a.asked AND NOT b.asked GROUP BY ALL),
vectors AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, doc_id) AS v FROM near QUALIFY v <= 50)"""


@query(
    f"""
WITH {_TOKENS}, {_SEARCH}, {_ECHO.lstrip()},
hits AS (SELECT query_id, doc_id, greatest(vectors.sim, least(0.5, abs(rank) / (abs(rank) + 3))) AS sim, CASE WHEN rank IS NULL THEN 'vector' WHEN v IS NULL THEN 'fts' ELSE 'both' END AS src, v, f FROM vectors FULL JOIN fts USING (query_id, doc_id)),
asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 1 + item_id % 3 END AS own, item_id % 9 AS minor, (item_id % 9) * (CASE item_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 7 END) % 9 AS line FROM benchmark),
docs AS (SELECT doc_id, source AS component, CASE WHEN lang = 'de' THEN 0.6 ELSE 1.0 END AS kind_weight, coalesce(quality = 1, false) AS closed, TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 700) DAY AS born, doc_id % 9 AS low FROM documents LEFT JOIN labels USING (doc_id)),
fit AS (SELECT h.*, component, kind_weight, closed, born + (CASE WHEN closed THEN INTERVAL 30 DAY ELSE INTERVAL 0 DAY END) AS since, low,
  CASE WHEN own IS NULL THEN 5 WHEN component = 'src' || own THEN minor WHEN component = 'src1' THEN line WHEN component = 'src2' THEN line * 2 % 9 WHEN component = 'src3' THEN line * 4 % 9 ELSE 5 END AS ref FROM hits h JOIN asked USING (query_id) JOIN docs USING (doc_id)),
conf AS (SELECT *, CASE WHEN ref < low THEN pow(2.0, -(low - ref) / 1.5) WHEN closed AND ref > low + 1 THEN pow(2.0, -((ref - low - 1) + 0.2) / 1.5) ELSE 1.0 END AS w FROM fit),
final AS (SELECT *, pow(least(sim, 1.0), 0.6) * pow((0.15 + 0.85 * pow(2.0, -greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(since)) / 86400e6) / 365)) * (0.6 * w + 0.4 * kind_weight * CASE WHEN closed THEN 0.6 ELSE 0.4 END), 0.4) AS final FROM conf),
late AS (SELECT *, coalesce(max(CASE WHEN closed THEN round(sim, 4) END) OVER (PARTITION BY query_id) < 0.5, false) AND closed AS late FROM final)
SELECT query_id, doc_id, src, round(final, 6) AS final, closed AS resolved, '0.' || ref || '.0' AS version_ref,
  row_number() OVER (PARTITION BY query_id ORDER BY late::INT, round(final, 9) DESC, v NULLS LAST, f NULLS LAST, doc_id) AS place FROM late QUALIFY place <= 10"""
)
def component_search_items(spark, sf_dir):
    """Every benchmark item as a query, whole: embedded and recalled among the vectors of all documents, searched as a phrase or
    by prefixes, merged and weighted. Each second one names a component and a version, whose companions come from a matrix.
    """
    docs = derived_documents(spark, sf_dir)
    chunks = docs.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    held = stored(embedded(chunks, "echo").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding"), "vectors")
    minor = lambda factor: F.concat(F.lit("0."), (F.col("row_id") * factor % 9).cast("string"), F.lit(".0"))
    matrix = docs.select((F.col("doc_id") % 9).alias("row_id")).distinct().withColumns({c: minor(f) for c, f in _MATRIX.items()})
    text = lambda n: (F.col("item_id") % n).cast("string")
    named = F.concat(F.lit("src"), (F.col("item_id") % 3 + 1).cast("string"), F.lit(":0."), text(9), F.lit(".0 "), "text")
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, named).otherwise(F.col("text")).alias("text"))
    index, lengths = index_of_documents(spark, sf_dir)
    hits = component_search(
        docs.select("chunk_id", "doc_id"), docs.drop("text", "chunk_id"), index, lengths, texts, F.lit(NOW).cast("timestamp"), F.lit("0.5.0"), vectors_of=held, cells=companion.unpivoted(matrix, tuple(_MATRIX))
    )
    return hits.select("query_id", "doc_id", "src", F.round("final", 6).alias("final"), "resolved", "version_ref", F.col("place").cast("bigint").alias("place"))
