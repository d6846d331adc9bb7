"""Canonical sinks, incremental ingestion, the review queue, counts and JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canonical, ingest, review
from ..plans import search
from .registry import registry, table

QUERIES, ORACLES, query = registry()


@query("SELECT conv_id, string_agg('### ' || coalesce(role, 'unknown') || ' (t' || turn || '):' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS thread, count(*)::INT AS n FROM conversations GROUP BY conv_id")
def thread_assembly(spark, sf_dir):
    comments = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("login"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("created_at"), F.col("text").alias("body"))
    return canonical.threads(comments, "conv_id", "turn")


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS body, count(*)::INT AS n_chunks FROM conversations GROUP BY conv_id")
def doc_body_concat(spark, sf_dir):
    return search.document(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text"))


def _items(spark, sf_dir):
    """Orders as raw issues and change requests."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select(
        k.alias("number"), F.concat(F.when(k % 2 == 0, "[Bug]: x").otherwise("y"), k.cast("string")).alias("title"), F.concat(F.lit(" engine 0."), (k % 9).cast("string"), F.lit(".1 fails ")).alias("body"),
        F.when(k % 5 == 0, F.array(F.lit("v0.3"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), day.alias("created_at"), day.alias("updated_at"),
        F.when(F.col("o_orderstatus") == "F", day).alias("closed_at"), F.lit(None).cast("string").alias("html_url"), (k % 3 == 0).alias("is_pr"), (k % 6 == 0).alias("merged"), F.when(k % 6 == 0, day).alias("merged_at"),
    )


@query(
    """
WITH o AS (SELECT *, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS day, o_orderstatus = 'F' AS f FROM orders),
c AS (SELECT conv_id, string_agg('### ' || coalesce(role, 'unknown') || ' ():' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS t, count(*)::INT AS n FROM conversations GROUP BY 1)
SELECT CASE WHEN k % 3 = 0 THEN 'github_pr' ELSE 'github_issue' END AS source_type, 'github:own-repo:' || CASE WHEN k % 3 = 0 THEN 'pr' ELSE 'issue' END || ':' || k AS source_id,
  'engine 0.' || k % 9 || '.1 fails' || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || t, '') AS body, CASE WHEN k % 6 = 0 THEN 'merged' WHEN f THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN k % 6 = 0 THEN day WHEN f THEN day END AS resolved_at, CASE WHEN k % 2 = 0 THEN 'bug' ELSE 'other' END AS kind,
  CASE WHEN k % 5 = 0 THEN '0.3' WHEN k % 3 <> 0 THEN '0.' || k % 9 || '.1' END AS version_min, coalesce(n, 0) AS comment_count FROM o LEFT JOIN c ON conv_id = k"""
)
def canonical_documents(spark, sf_dir):
    comments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("number"), F.col("turn").alias("position"), F.col("role").alias("login"), F.lit("").alias("created_at"), F.col("text").alias("body"))
    docs = canonical.canonical_documents(_items(spark, sf_dir), comments, "own/repo", "engine", {"engine": (("engine",), r"0\.\d+\.\d+")})
    return docs.select("source_type", "source_id", "body", "status", "resolved_at", "kind", "version_min", "comment_count")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def canonical_first_wins(spark, sf_dir):
    """Of documents with one text the first."""
    return canonical.first_wins(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0")
def canonical_append(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return canonical.new_rows(docs, docs.where("doc_id % 3 = 0"), "doc_id")


def _batches(spark, sf_dir):
    """What is stored, and a batch in which a third of the texts and a fifth of the sources differ and others are new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    stored = ingest.hashed(docs.where("doc_id % 7 <> 0"), ["doc_id", "text"], ["doc_id", "text", "source"])
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text"))).withColumn("source", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("source")))
    return stored, ingest.hashed(changed, ["doc_id", "text"], ["doc_id", "text", "source"])


_PLAN = "plan AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 'embed' WHEN doc_id % 5 = 0 THEN 'refresh' ELSE 'skip' END AS action FROM documents)"


@query(f"WITH {_PLAN} SELECT * FROM plan")
def ingest_plan(spark, sf_dir):
    stored, incoming = _batches(spark, sf_dir)
    return ingest.plan(incoming, stored, "doc_id").select("doc_id", "action")


@query(f"WITH {_PLAN} SELECT action, count(*) AS n FROM plan GROUP BY 1")
def ingest_plan_counts(spark, sf_dir):
    return ingest_plan(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256('=' || doc_id || chr(31) || '=' || text || CASE WHEN doc_id % 3 = 0 THEN '+' ELSE '' END) AS embed_hash FROM documents")
def ingest_upsert(spark, sf_dir):
    stored, incoming = _batches(spark, sf_dir)
    return ingest.upsert(stored, incoming, "doc_id").select("doc_id", "embed_hash")


@query()
def streaming_ingest_equals_batch(spark, sf_dir):
    """The events as a stream of files: the stored state after all micro-batches. A test holds it against the batch."""
    from ..streaming.ingest import run_available

    return run_available(spark, f"{sf_dir.rstrip('/')}/events.parquet", "event_id", ["event_id", "props"], ["event_id", "props", "value", "event_type"])


def _events(spark, sf_dir):
    """Events as actions on items of the review queue."""
    status = F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "approved").when(F.col("event_id") % 4 == 2, "suspected").otherwise("deleted")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("item"), F.col("ts").alias("at"), status.alias("status"), F.col("event_type").alias("category"))


_EV = "ev AS (SELECT event_id AS id, user_id AS item, ts, (['pending', 'approved', 'suspected', 'deleted'])[event_id % 4 + 1] AS status, event_type AS category FROM events), last AS (SELECT item, status FROM ev QUALIFY row_number() OVER (PARTITION BY item ORDER BY ts DESC, id DESC) = 1)"


@query(f"WITH {_EV} SELECT * FROM last")
def review_latest_state(spark, sf_dir):
    return review.latest(_events(spark, sf_dir)).select("item", "status")


@query(f"WITH {_EV}, r AS (SELECT item, status, row_number() OVER (PARTITION BY item ORDER BY ts DESC, id DESC) AS n, lead(status) OVER (PARTITION BY item ORDER BY ts DESC, id DESC) AS before FROM ev) SELECT item, coalesce(before, 'pending') AS restored FROM r WHERE n = 1 AND status = 'deleted'")
def review_undo(spark, sf_dir):
    return review.undone(_events(spark, sf_dir))


@query(f"WITH {_EV} SELECT item, status FROM last ORDER BY list_position(['pending', 'suspected', 'approved', 'deleted'], status), item DESC LIMIT 25 OFFSET 10")
def review_queue_page(spark, sf_dir):
    """The second page of the queue."""
    return review.page(review.latest(_events(spark, sf_dir)).select("item", "status"), 10, 25)


@query(f"WITH {_EV} SELECT category, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'suspected') AS suspected, count(*) AS total FROM ev GROUP BY 1")
def review_stats(spark, sf_dir):
    return review.statistics(_events(spark, sf_dir))


@query(f"WITH {_EV} SELECT DISTINCT category, item AS item_ref FROM ev WHERE (category, item) NOT IN (SELECT category, item FROM ev WHERE id % 3 = 0)")
def review_dedupe(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumnRenamed("item", "item_ref")
    return review.added(rows.select("category", "item_ref"), rows.where("id % 3 = 0"))


@query(f"WITH {_EV} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item FROM last WHERE status = 'deleted')")
def review_deleted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return review.without_deleted(docs, review.latest(_events(spark, sf_dir)).withColumnRenamed("item", "doc_id"), "doc_id")


@query("SELECT source AS source_type, doc_id AS source_id FROM documents WHERE NOT starts_with(source, 'src1') ORDER BY source, doc_id LIMIT 30 OFFSET 20")
def external_docs_page(spark, sf_dir):
    """The second page of documents that come from outside."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_type"), F.col("doc_id").alias("source_id"))
    return docs.where(~F.startswith("source_type", F.lit("src1"))).orderBy("source_type", "source_id").offset(20).limit(30)


@query("SELECT source AS component, count(*) AS n FROM documents GROUP BY source")
def components_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("component")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component")


@query("SELECT count(*) AS documents, count(*) FILTER (quality IS NOT NULL) AS labelled, sum((greatest(n_chars, 1) - 1) // 4000 + 1)::BIGINT AS chunks FROM documents LEFT JOIN labels USING (doc_id)")
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.agg(F.count("*").alias("documents"), F.count_if(F.col("quality").isNotNull()).alias("labelled"), F.sum(F.floor((F.greatest("n_chars", F.lit(1)) - 1) / 4000) + 1).cast("bigint").alias("chunks"))


@query("SELECT event_id, json_keys(props) AS keys FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.json_object_keys("props").alias("keys"))


#: Forms of one deployment, given as parameters.
IMAGE_FORMS = {"cann": r"(?i)cann[^0-9]*(\d+\.\d+(?:\.\d+)?(?:\.?rc\d+)?)", "soc": r"^SOC_VERSION=(\S+)", "python": r"(?i)python[-/]?(\d+\.\d+(?:\.\d+)?)"}


@query("SELECT p_partkey AS id, '8.' || p_partkey % 5 || '.rc1' AS cann, 'dev' || p_partkey % 3 AS soc, CASE WHEN p_partkey % 2 = 0 THEN '3.' || p_partkey % 4 + 9 ELSE '' END AS python FROM part")
def env_list_extract(spark, sf_dir):
    """Versions in the environment of images."""
    from ..operators.companion import environment_versions

    n = lambda m, add=0: (F.col("p_partkey") % m + add).cast("string")
    env = F.array(F.lit("HOME=/root"), F.concat(F.lit("SOC_VERSION=dev"), n(3)), F.concat(F.lit("TOOL=/usr/cann-8."), n(5), F.lit(".rc1/lib")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("PATH=/opt/python3."), n(4, 9))).otherwise("PATH=/bin"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), environment_versions(env, IMAGE_FORMS).alias("v")).select("id", "v.*")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '0.' || p_partkey % 7 || '.1' WHEN 1 THEN '0.' || p_partkey % 5 || '.2' ELSE '0.3.' || p_partkey % 4 END AS version, (['upstream', 'notes', 'tag'])[p_partkey % 3 + 1] AS source FROM part")
def release_notes_version(spark, sf_dir):
    """The version of another component that release notes name, and where it was found."""
    from ..operators.companion import noted_version

    n = lambda m: (F.col("p_partkey") % m).cast("string")
    notes = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("engine 9.9.9; upstream Engine v0."), n(7), F.lit(".1"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("works with engine 0."), n(5), F.lit(".2"))).otherwise("none")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), noted_version(notes, F.concat(F.lit("v0.3."), n(4), F.lit("rc1")), "engine").alias("v")).select("id", "v.*")


@query("SELECT doc_id AS item_ref, 'unverified' AS category FROM documents WHERE doc_id % 4 = 1 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'title' FROM documents WHERE doc_id % 5 = 2 AND doc_id % 3 <> 0")
def review_seeds(spark, sf_dir):
    """Unverified documents and marked titles that the queue doesn't have yet; a second run adds nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 1, "unverified").otherwise("tested").alias("verification"), F.when(F.col("doc_id") % 5 == 2, "[待审核] a").otherwise("b").alias("title"))
    new = docs.where("verification = 'unverified'").select(F.lit("unverified").alias("category"), F.col("doc_id").alias("item_ref")).unionByName(docs.where(F.col("title").rlike("待审核|待修改")).select(F.lit("title").alias("category"), F.col("doc_id").alias("item_ref")))
    return review.added(new, new.where("item_ref % 3 = 0"))


@query("SELECT doc_id, substr(text, 1, 500) AS snippet FROM documents")
def result_snippets(spark, sf_dir):
    return search.search_result(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT page_id, '| url | n |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(replace(url, '|', '\\|'), chr(10), ' ') || ' |  |' AS body FROM pages")
def table_to_markdown(spark, sf_dir):
    from ..sources.registry import markdown_table

    rows = F.array(F.array(F.lit("url"), F.lit("n")), F.array("url"))
    return table(spark, sf_dir, "pages").select("page_id", markdown_table(rows).alias("body"))


@query("SELECT page_id, 'src/p' || page_id || '.py' AS path FROM pages WHERE page_id % 4 = 0")
def indexed_paths(spark, sf_dir):
    """Paths in indexed folders, of indexed kinds, outside excluded folders."""
    from ..operators.code import indexed_sources

    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py"))).when(k % 4 == 1, F.lit("src/tests/a.py")).when(k % 4 == 2, F.lit("docs/x.py")).otherwise("src/readme.txt")
    return indexed_sources(table(spark, sf_dir, "pages").select("page_id", path.alias("path")), ["src"])


@query("WITH f AS (SELECT doc_id, doc_id % 10 || '.png' AS file, sha256(text) AS sha, first_value(sha256(text)) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id::VARCHAR) AS f FROM documents) SELECT doc_id::VARCHAR || '/' || file AS path, sha, CASE WHEN sha = f THEN file ELSE replace(file, '.png', '') || '.' || substr(sha, 1, 12) || '.png' END AS name FROM f")
def asset_copies(spark, sf_dir):
    """Documents as files of ten names: equal ones share a name, others get their hash."""
    from ..sources.registry import asset_names

    docs = table(spark, sf_dir, "documents")
    return asset_names(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), (F.col("doc_id") % 10).cast("string"), F.lit(".png")).alias("path"), F.encode("text", "UTF-8").alias("content")))
