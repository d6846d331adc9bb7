"""The vector store, the graph build, parsers, substring symbols and signal words, review backups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsing, symbols
from ..operators import companion, graph, ingest, review
from ..operators.chunking import chunk_documents
from ..operators.stored import shared_folder
from ..operators.vector_store import VectorStore
from ..plans import build, search
from ..sources.registry import mean_confidence
from .registry import registry, table

QUERIES, ORACLES, query = registry()


@query("SELECT vec_id::VARCHAR AS chunk_id, (label % 10)::VARCHAR AS doc_id, CASE WHEN label % 10 = 3 THEN 'new' ELSE label::VARCHAR END AS kind, len(embedding)::INT AS dim FROM embeddings WHERE label % 10 <> 7")
def vector_store_changes(spark, sf_dir):
    """All vectors put into a store, the documents of one label deleted and those of another given new meta; then read again."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), (F.col("label") % 10).cast("string").alias("doc_id"), "embedding", F.create_map(F.lit("kind"), F.col("label").cast("string")).alias("meta"))
    store = VectorStore(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/vectors-{uuid.uuid4().hex}", buckets=8)
    store.add(rows)
    store.delete(spark.createDataFrame([("7",)], "doc_id string"))
    store.update_meta(spark.createDataFrame([("3", {"kind": "new"})], "doc_id string, meta map<string,string>"))
    return store.read().select("chunk_id", "doc_id", F.col("meta")["kind"].alias("kind"), F.size("embedding").alias("dim"))


@query("SELECT 'ok' AS status, count(*) AS vectors, 'closed' AS embedding FROM embeddings")
def health(spark, sf_dir):
    return search.health(table(spark, sf_dir, "embeddings"))


_ORDERS = """o AS (SELECT *, o_orderkey AS n, o_orderkey % 3 = 0 AS pr FROM orders),
i AS (SELECT 'github:own-repo:issue:' || n AS id FROM o WHERE NOT pr), p AS (SELECT 'github:own-repo:pr:' || n AS id, n, o_orderdate FROM o WHERE pr),
f AS (SELECT id AS src, 'github:own-repo:issue:' || (n + 1) AS dst FROM p UNION SELECT 'github:own-repo:pr:' || (n - 2), 'github:own-repo:issue:' || n FROM o WHERE NOT pr AND n % 3 = 2),
r AS (SELECT date_trunc('month', o_orderdate) AS d FROM orders GROUP BY 1), m AS (SELECT id AS src, 'own/repo:v' || year(min(d)) || '.' || month(min(d)) AS dst FROM p JOIN r ON d >= date_trunc('minute', o_orderdate) GROUP BY id)"""


_GRAPH_COUNTS = (
    f"""WITH {_ORDERS}
SELECT 'node' AS kind, 'issue' AS label, count(*) AS n FROM i UNION ALL SELECT 'node', 'request', count(*) FROM p UNION ALL SELECT 'node', 'document', count(*) FROM pages UNION ALL SELECT 'node', 'release', count(DISTINCT dst) FROM m
UNION ALL SELECT 'node', 'interface', count(DISTINCT page_id % 11) FROM pages UNION ALL SELECT 'edge', 'documents', count(*) FROM pages
UNION ALL SELECT 'edge', 'fixes', count(*) FROM f WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM i) UNION ALL SELECT 'edge', 'merged_in', count(*) FROM m"""
)


def _graph_inputs(spark, sf_dir):
    """Orders as issues and change requests, pages as manuals, months as releases."""
    key = F.col("o_orderkey")
    is_pr, number = key % 3 == 0, lambda n: (key + n).cast("string")
    text = F.when(is_pr, F.concat(F.lit("Fixes #"), number(1))).when(key % 3 == 2, F.concat(F.lit("fixed by #"), number(-2))).otherwise("open")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    items = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("github:own-repo:"), F.when(is_pr, "pr").otherwise("issue"), F.lit(":"), number(0)).alias("source_id"), F.when(is_pr, "github_pr").otherwise("github_issue").alias("source_type"), F.lit("own/repo").alias("repo"),
        key.alias("number"), F.lit("t").alias("title"), text.alias("body"), F.lit("closed").alias("status"), day.alias("created_at"), day.alias("resolved_at"), F.when(is_pr, day).alias("merged_at"), F.lit(None).cast("string").alias("url"),
    )
    manuals = table(spark, sf_dir, "pages").select(F.concat(F.lit("doc:"), F.col("page_id").cast("string")).alias("source_id"), F.lit("doc_pdf").alias("source_type"), F.lit("m").alias("title"), F.concat(F.lit("命令格式\ntool -sub"), (F.col("page_id") % 11).cast("string")).alias("body"))
    months = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp").alias("date")).distinct()
    calendar = months.select(F.lit("own/repo").alias("repo"), F.concat(F.lit("v"), F.date_format("date", "yyyy.M")).alias("tag"), "date", F.lit("release").alias("kind"))
    return items.unionByName(manuals, allowMissingColumns=True), calendar


def _no_entities(text):
    return F.array().cast("array<struct<kind:string,name:string>>")


@query(_GRAPH_COUNTS)
def graph_build_counts(spark, sf_dir):
    """The graph of orders as issues and change requests and pages as manuals, built and counted."""
    docs, calendar = _graph_inputs(spark, sf_dir)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}"
    graph.write(graph.relations(docs, calendar, _no_entities), path)
    counts = graph.built_statistics(spark, path).drop("built")
    return counts.where("n > 0")


@query(_GRAPH_COUNTS)
def graph_update_counts(spark, sf_dir):
    """The same graph, but of documents that came in two parts; the first part's texts changed with the second one, and documents
    that were there for a while went.
    """
    docs, calendar = _graph_inputs(spark, sf_dir)
    store = graph.GraphStore(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}")
    first = docs.where("coalesce(number, 0) % 4 = 0")
    passing = docs.where("number is not null").withColumns({"source_id": F.concat("source_id", F.lit("9")), "source_type": F.lit("github_pr")})
    store.update(first.withColumn("body", F.lit("Fixes #1")).unionByName(passing), _no_entities)
    store.update(docs, _no_entities, removed=passing.select("source_id"))
    tables = store.read(calendar)
    parts = {k: {n.partition("_")[2]: t for n, t in tables.items() if n.startswith(k)} for k in ("node", "edge")}
    return graph.statistics(parts["node"], parts["edge"]).where("n > 0")


def _lengths(texts):
    """Stands for an embedding service."""
    return [[float(len(t)), 1.0] for t in texts]


@query(
    """
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS b FROM documents),
cut AS (SELECT doc_id, b, unnest(range(0, (length(b) - 1) // 4000 + 1)) AS k FROM t WHERE length(b) > 0),
chunk AS (SELECT doc_id, CASE WHEN k > 0 THEN substr(b, k * 4000 - 199, 200) || chr(10) ELSE '' END || substr(b, k * 4000 + 1, 4000) AS text FROM cut)
SELECT 'docs' AS part, count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents UNION ALL SELECT 'chunks', count(*), sum(length(text))::BIGINT FROM chunk UNION ALL SELECT 'vectors', count(*), sum(length(text))::BIGINT FROM chunk"""
)
def build_in_two_parts(spark, sf_dir):
    """A knowledge base of all documents, taken in by two builds; the second changes a tenth of what the first took in."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit("t").alias("title"), F.col("text").alias("body"), F.lit("open").alias("status"))
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/kb-{uuid.uuid4().hex}"
    half = docs.where("cast(source_id as bigint) % 2 = 0")
    build.ingest_documents(spark, half.withColumn("body", F.when(F.col("source_id").endswith("0"), "another text").otherwise(F.col("body"))), path, provider=_lengths)
    built = build.ingest_documents(spark, docs, path, provider=_lengths)
    row = lambda part, df, value: df.agg(F.count("*").alias("n"), F.sum(value).cast("bigint").alias("total")).select(F.lit(part).alias("part"), "n", "total")
    return row("docs", built.docs, F.col("source_id").cast("bigint")).unionByName(row("chunks", built.chunks, F.length("text"))).unionByName(row("vectors", built.vectors.read(), F.get("embedding", F.lit(0))))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 'engine' || p_partkey % 5 END AS component, CASE WHEN p_partkey % 3 < 2 THEN '0.' || p_partkey % 9 || '.rc1' END AS version, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' : x' ELSE 'no prefix: ' || p_name END AS rest FROM part")
def component_query_parse(spark, sf_dir):
    """Queries as users write them: component, version, and the rest."""
    key, n = F.col("p_partkey"), lambda m: (F.col("p_partkey") % m).cast("string")
    prefix = F.concat(F.lit("engine"), n(5), F.lit(" : 0."), n(9), F.lit(".rc1  "))
    text = F.when(key % 3 == 0, F.concat(F.lit(" "), prefix, "p_name", F.lit(" "))).when(key % 3 == 1, F.concat(prefix, "p_name", F.lit(" : x"))).otherwise(F.concat(F.lit("no prefix: "), "p_name"))
    return table(spark, sf_dir, "part").select(key.alias("id"), parsing.component_query(text).alias("q")).select("id", "q.*")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'github:own-repo:issue:' || o_orderkey WHEN 1 THEN 'github:x-y:issue:' || o_orderkey WHEN 2 THEN 'github:a-b:pr:' || o_orderkey ELSE 'word' || o_orderkey END AS ref FROM orders")
def document_references(spark, sf_dir):
    """References as users write them, by short name, by repository, as an id, or as a word."""
    key, k = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    text = F.when(key % 4 == 0, F.concat(F.lit("own#"), k)).when(key % 4 == 1, F.concat(F.lit("x/y#"), k)).when(key % 4 == 2, F.concat(F.lit("github:a-b:pr:"), k)).otherwise(F.concat(F.lit("word"), k))
    return table(spark, sf_dir, "orders").select(key.alias("id"), parsing.document_reference(text, "issue", {"own": "own/repo"}).alias("ref"))


_BODY = "(['**Engine version**: 0.', '- engine: v1.', 'pip install engine==2.', 'engine/engine-x:v3.', 'engine 0.'])[o_orderkey % 5 + 1] || o_orderkey % 7 || CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE '.' || o_orderkey % 3 END"


@query(rf"WITH b AS (SELECT o_orderkey AS id, {_BODY} AS body FROM orders) SELECT id, coalesce(nullif(regexp_extract(body, '(?i)engine\s+version[^0-9]*(\d+\.\d+(?:\.\d+)?)', 1), ''), nullif(regexp_extract(body, '(?i)\bengine[\s:=_-]*v?(\d+\.\d+\.\d+)', 1), '')) AS version FROM b")
def body_versions(spark, sf_dir):
    """The version that a report's body names: in its form, else a whole one after the name."""
    key = F.col("o_orderkey")
    head = F.get(F.array(*map(F.lit, ("**Engine version**: 0.", "- engine: v1.", "pip install engine==2.", "engine/engine-x:v3.", "engine 0."))), (key % 5).cast("int"))
    body = F.concat(head, (key % 7).cast("string"), F.when(key % 5 == 4, "").otherwise(F.concat(F.lit("."), (key % 3).cast("string"))))
    return table(spark, sf_dir, "orders").select(key.alias("id"), parsing.body_version(body, "engine").alias("version"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'fork' WHEN 1 THEN 'own' WHEN 2 THEN 'a-b' || s_suppkey ELSE 'doc' END AS component FROM supplier")
def default_components(spark, sf_dir):
    """The component that a repository's name stands for."""
    key = F.col("s_suppkey")
    repo = F.when(key % 4 == 0, "X/own-fork").when(key % 4 == 1, "x/OWN").when(key % 4 == 2, F.concat(F.lit("A/b"), key.cast("string")))
    return table(spark, sf_dir, "supplier").select(key.alias("id"), parsing.default_component(repo, [(("own-fork", "own_fork"), "fork"), (("own",), "own")]).alias("component"))


@query(
    """WITH t AS (SELECT 'v0.' || p_partkey % 9 || '.0' AS base, p_partkey % 2 = 0 AS plain FROM part), b AS (SELECT base, substr(base, 4, 1)::INT AS k FROM t GROUP BY 1)
SELECT base AS own, CASE WHEN k % 3 = 0 THEN '0.' || k || '.7' ELSE '0.' || k || '.0' END AS engine, CASE WHEN k % 2 = 0 THEN '8.' || k ELSE '' END AS cann,
  CASE WHEN k % 2 = 0 THEN 'SOC=dev' || k || '; python=3.11' ELSE '' END AS notes, 'auto(' || CASE WHEN k % 2 = 0 THEN 'cann=image+' ELSE '' END || 'engine=' || CASE WHEN k % 3 = 0 THEN 'upstream' ELSE 'tag' END || ')' AS source FROM b"""
)
def companion_from_tags(spark, sf_dir):
    """Companion rows of image tags, from their environment and release notes, with where each cell comes from."""
    minor = (F.col("p_partkey") % 9).cast("string")
    base = F.concat(F.lit("v0."), minor, F.lit(".0"))
    tags = table(spark, sf_dir, "part").select(base.alias("base"), F.when(F.col("p_partkey") % 2 == 0, base).otherwise(F.concat(base, F.lit("-a3"))).alias("tag")).distinct()
    k = F.substring("tag", 4, 1)
    images = tags.where(k.cast("int") % 2 == 0).select("tag", F.array(F.concat(F.lit("HOME=/cann-8."), k), F.concat(F.lit("SOC_VERSION=dev"), k), F.lit("PATH=/python3.11/bin")).alias("env"))
    b = F.substring("base", 4, 1)
    notes = tags.select("base").distinct().where(b.cast("int") % 3 == 0).select("base", F.concat(F.lit("engine 9.9.9, but based on Engine v0."), b, F.lit(".7")).alias("body"))
    return companion.rows_of_tags(tags, images, notes, "own", "engine")


_PIECES = "w AS (SELECT DISTINCT lower(substr(regexp_extract(text, '[A-Za-z]+'), 2, 4)) AS key FROM benchmark WHERE length(regexp_extract(text, '[A-Za-z]+')) >= 5)"


def _pieces(spark, sf_dir):
    """Parts of words, as names that stand inside other words."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    return table(spark, sf_dir, "benchmark").where(F.length(word) >= 5).select(F.lower(F.substring(word, 2, 4)).alias("key")).distinct()


@query(f"WITH {_PIECES} SELECT doc_id AS id, key AS name, 'kernel' AS kind, 1.0::DOUBLE AS weight FROM documents, w WHERE contains(lower(text), key)")
def symbols_inside_words(spark, sf_dir):
    """Symbols that texts hold anywhere, inside other words too."""
    symbol_table = _pieces(spark, sf_dir).select("key", F.col("key").alias("name"), F.lit("kernel").alias("kind"), F.lit(1.0).alias("weight"))
    found = symbols.match_symbols(table(spark, sf_dir, "documents"), symbol_table, "doc_id")
    # spellings of whole words (weight 0.9) aren't asked for here
    return found.where("weight = 1.0").select("id", "name", "kind", "weight")


@query(f"WITH {_PIECES}, h AS (SELECT conv_id || '/' || turn AS id, key AS word, length(key)::DOUBLE + ascii(key) AS score FROM conversations, w WHERE length(key) >= 4 AND contains(lower(text), key)) SELECT id, word, score, n::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, score DESC, word) AS n FROM h) WHERE n <= 15")
def signal_word_matches(spark, sf_dir):
    """The signal words that turns of conversations hold: longest first, then by score, fifteen at most."""
    words = _pieces(spark, sf_dir).select(F.col("key").alias("word"), (F.length("key").cast("double") + F.ascii("key")).alias("score"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return symbols.match_signal_words(turns, words)


@query("SELECT doc_id, md5(text) AS sum FROM documents")
def review_backup_restore(spark, sf_dir):
    """A third of the documents backed up, removed, and put back."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("doc_id % 3 = 0").select("doc_id")
    backup = review.backed_up(docs, gone, "doc_id")
    return review.restored(docs.join(gone, "doc_id", "left_anti").select(docs.columns), backup, "doc_id").select("doc_id", F.md5("text").alias("sum"))


@query("SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN 'new' ELSE md5(html) END AS sum FROM pages WHERE page_id % 10 <> 0 AND trim(html) <> ''")
def chunks_replaced(spark, sf_dir):
    """Documents cut again: some have new chunks, some none any more, the others keep theirs."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("body"))
    old = chunk_documents(pages, most=1 << 30, overlap=0)
    again = pages.where("source_id % 5 = 0").withColumn("body", F.when(F.col("source_id") % 10 == 0, "").otherwise("new"))
    now = ingest.replace_chunks(old, again.select(F.col("source_id").alias("doc_id")), chunk_documents(again))
    return now.join(pages, F.col("doc_id") == F.col("source_id")).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.md5("body")).alias("sum"))


@query("SELECT l_orderkey AS id, round(avg(l_discount), 9) AS confidence FROM lineitem GROUP BY 1")
def mean_line_confidence(spark, sf_dir):
    """The mean confidence of recognised lines; here a line item is a line."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.lit("x").alias("text"), F.col("l_discount").alias("confidence"))).alias("lines"))
    return lines.select("id", F.round(mean_confidence(F.col("lines")), 9).alias("confidence"))


@query("SELECT 'v0.' || page_id % 12 AS version, count(*) AS files FROM pages WHERE page_id % 2 = 0 GROUP BY 1")
def code_version_list(spark, sf_dir):
    """The versions of one repository's sources, and how many files each has."""
    k = F.col("page_id")
    sources = table(spark, sf_dir, "pages").select(F.when(k % 2 == 0, "own").otherwise("other").alias("repo"), F.concat(F.lit("v0."), (k % 12).cast("string")).alias("version"), k.cast("string").alias("path"))
    return search.code_versions(sources, "own")


@query("SELECT p_partkey AS id, (['GLM-5.', 'deepseek-V4-', 'CANN 8.', 'plain '])[p_partkey % 4 + 1] || p_partkey % 7 AS name, CASE WHEN p_partkey % 4 < 2 THEN 'model' ELSE 'version' END AS kind FROM part WHERE p_partkey % 4 < 3")
def title_models_versions(spark, sf_dir):
    """Models and versions that titles name."""
    key = F.col("p_partkey")
    name = F.concat(F.get(F.array(*map(F.lit, ("GLM-5.", "deepseek-V4-", "CANN 8.", "plain "))), (key % 4).cast("int")), (key % 7).cast("string"))
    titles = table(spark, sf_dir, "part").select(key.alias("id"), name.alias("name"), F.concat(F.lit("it hangs: "), name, F.lit(" here")).alias("title"))
    found = symbols.title_mentions(titles).select("name", "kind").distinct()
    return titles.select("id", "name").join(found, "name").select("id", "name", "kind")
