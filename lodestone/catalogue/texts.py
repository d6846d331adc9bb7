"""Text functions over texts that are put together from columns, so that both engines have the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references, signatures, symbols
from ..functions.text import truncated
from ..operators import canonical
from ..operators.stored import spread_out
from ..plans.search import signature_search, title_search
from .registry import registry, table

QUERIES, ORACLES, query = registry()


def _mod(c, n):
    return (F.col(c) % n).cast("string")


def _reports(spark, sf_dir):
    """An error report for each part."""
    k = "p_partkey"
    text = F.concat(
        F.lit("kernel_name=Op"), _mod(k, 7), F.lit(" failed, error code: "), (F.col(k) % 40 + 500000).cast("string"), F.lit("\nRuntimeError: out of memory in csrc/mod"), _mod(k, 5), F.lit(".cpp\nnpuMul"), _mod(k, 3),
        F.lit(" moe_"), F.lit("x"), _mod(k, 4), F.lit(" fixes #"), _mod(k, 50), F.lit(" and closes acme/tool#"), _mod(k, 30), F.lit(" enable_fast"), _mod(k, 2),
    )
    parts = spread_out(table(spark, sf_dir, "part").select(k, "p_name", "p_brand"))
    return parts.select(F.col(k).alias("id"), text.alias("text"), F.col("p_name").alias("title"), F.col("p_brand").alias("component"))


_REPORT = """
rep AS (SELECT p_partkey AS id, 'kernel_name=Op' || p_partkey % 7 || ' failed, error code: ' || (p_partkey % 40 + 500000) || chr(10) || 'RuntimeError: out of memory in csrc/mod' || p_partkey % 5 || '.cpp' || chr(10) || 'npuMul' || p_partkey % 3
  || ' moe_' || 'x' || p_partkey % 4 || ' fixes #' || p_partkey % 50 || ' and closes acme/tool#' || p_partkey % 30 || ' enable_fast' || p_partkey % 2 AS text, p_partkey AS p, p_name AS title FROM part)"""


@query(
    f"""
WITH {_REPORT.lstrip()}
SELECT id, unnest([{{'kind': 'kernel', 'text': 'op' || p % 7}}, {{'kind': 'kernel', 'text': 'npumul' || p % 3}}, {{'kind': 'op', 'text': 'moe_x' || p % 4}}, {{'kind': 'errcode', 'text': (p % 40 + 500000)::VARCHAR}},
  {{'kind': 'env', 'text': 'enable_fast' || p % 2}}, {{'kind': 'op', 'text': 'op' || p % 7 || ' failed'}}, {{'kind': 'module', 'text': 'csrc/mod' || p % 5 || '.cpp'}}, {{'kind': 'phrase', 'text': 'runtimeerror'}}, {{'kind': 'phrase', 'text': 'out of memory'}}], recursive := true) FROM rep"""
)
def signature_extract(spark, sf_dir):
    """Signatures of every report; the SQL lists what its parts must give."""
    found = _reports(spark, sf_dir).select("id", F.explode(signatures.extract_signatures(F.col("text"))).alias("s"))
    return found.select("id", "s.kind", "s.text")


@query("SELECT p_partkey AS id, ['alpha_beta', '6', 'x' || p_partkey % 9 || 'yz'] AS texts FROM part")
def signature_dedupe(spark, sf_dir):
    """The first of equal ones stays, parts of longer ones go, codes are never parts."""
    s = lambda kind, text, w: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("text"), text, F.lit("weight"), F.lit(w), F.lit("origin"), F.lit(""))
    x = F.concat(F.lit("x"), _mod("p_partkey", 9), F.lit("yz"))
    some = F.array(s("op", F.lit("alpha"), 1.0), s("op", F.lit("alpha_beta"), 2.0), s("errcode", F.lit("6"), 3.0), s("op", F.lit("alpha_beta"), 9.0), s("env", x, 1.0), s("errcode", F.lit("6"), 1.0), s("env", F.lit("yz"), 1.0)).cast(signatures.SIGNATURE)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.transform(signatures.deduped(some), lambda t: t["text"]).alias("texts"))


def _searched(spark, sf_dir, **options):
    from ..operators import fulltext

    docs = _reports(spark, sf_dir)
    chunks = docs.select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), "text")
    found = signature_search(chunks, docs.withColumnRenamed("id", "doc_id"), fulltext.texts(chunks), docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), "text"), **options)
    return found.select("query_id", "doc_id", F.round("score", 3).alias("score"), "signatures", "place")


@query()
def signature_search_scores(spark, sf_dir):
    """Every report whose id is divisible by 20, searched among the first 30 reports of each signature; ``signature_search_whole`` takes all."""
    return _searched(spark, sf_dir, per_signature=30)


@query(
    f"""
WITH {_REPORT.lstrip()},
sig AS (SELECT id, title, unnest([{{'text': 'op' || p % 7, 'w': 3.5}}, {{'text': 'npumul' || p % 3, 'w': 3.0}}, {{'text': 'moe_x' || p % 4, 'w': 2.5}}, {{'text': (p % 40 + 500000)::VARCHAR, 'w': 3.0}},
  {{'text': 'enable_fast' || p % 2, 'w': 1.2}}, {{'text': 'op' || p % 7 || ' failed', 'w': 2.0}}, {{'text': 'csrc/mod' || p % 5 || '.cpp', 'w': 1.0}}, {{'text': 'runtimeerror', 'w': 1.2}}, {{'text': 'out of memory', 'w': 2.0}}], recursive := true) FROM rep),
pair AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.w::DOUBLE * CASE WHEN contains(lower(d.title), d.text) THEN 1.5 ELSE 1 END), 3)::DOUBLE AS score, list_sort(list(d.text)) AS signatures FROM sig q JOIN sig d ON q.text = d.text WHERE q.id % 20 = 0 GROUP BY q.id, d.id)
SELECT query_id, doc_id, score, signatures, (row_number() OVER w)::INT AS place FROM pair WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 15"""
)
def signature_search_whole(spark, sf_dir):
    """Every report whose id is divisible by 20, searched among all reports."""
    return _searched(spark, sf_dir)


@query(f"WITH {_REPORT.lstrip()}, r AS (SELECT id, 'acme/tool' AS repo, (p % 30)::BIGINT AS number FROM rep UNION SELECT id, 'own/repo', (p % 50)::BIGINT FROM rep) SELECT * FROM r")
def fix_references(spark, sf_dir):
    found = _reports(spark, sf_dir).select("id", F.explode(references.fix_references(F.col("text"), F.lit("own/repo"))).alias("r"))
    return found.select("id", "r.repo", "r.number")


@query("SELECT o_orderkey AS id, (o_orderkey % 90)::BIGINT AS number FROM orders WHERE o_orderkey % 4 < 2")
def fixed_by_references(spark, sf_dir):
    how = F.when(F.col("o_orderkey") % 4 == 0, "Fixed by #").when(F.col("o_orderkey") % 4 == 1, "was resolved  by #").when(F.col("o_orderkey") % 4 == 2, "fixed in #").otherwise("see #")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(how, _mod("o_orderkey", 90)).alias("text"))
    return rows.select("id", F.explode(references.fixed_by_references(F.col("text"), F.lit("own/repo"))).alias("r")).select("id", "r.number")


@query(f"WITH {_REPORT.lstrip()} SELECT id, unnest([{{'kind': 'error_code', 'name': (p % 40 + 500000)::VARCHAR}}, {{'kind': 'operator', 'name': 'moe_x' || p % 4}}, {{'kind': 'operator', 'name': 'npumul' || p % 3}}, {{'kind': 'operator', 'name': 'op' || p % 7}}], recursive := true) FROM rep")
def entity_mentions(spark, sf_dir):
    """Entities among the signatures of every report; phrases with spaces are no operators."""
    found = _reports(spark, sf_dir).select("id", F.explode(references.mentions(signatures.extract_signatures(F.col("text")))).alias("m"))
    return found.select("id", "m.kind", "m.name")


@query("SELECT p_partkey AS id, 'tool' || '_' || chr((97 + p_partkey % 3)::INT) || '.' || 'rate' || p_partkey % 4 AS interface FROM part WHERE p_partkey % 5 <> 0")
def interface_extract(spark, sf_dir):
    """Command forms of manuals; those with an action flag alone name no interface."""
    k = F.col("p_partkey")
    tool = F.concat(F.lit("tool_"), F.chr(k % 3 + 97))
    text = F.concat(F.lit("1 x\n命令格式\n  "), tool, F.lit(" [-i <id>] "), F.when(k % 5 == 0, "-h").otherwise(F.concat(F.lit("-rate"), _mod("p_partkey", 4))), F.lit(" [-g]\n"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.explode(references.interfaces(text)).alias("interface"))


@query("SELECT p_partkey AS id, unnest(list_distinct(['E' || (19999 + p_partkey % 8), (507000 + p_partkey % 30)::VARCHAR])) AS code FROM part")
def table_error_codes(spark, sf_dir):
    """Codes in the cells of parsed tables."""
    rows = F.array(F.array(F.lit("code"), F.concat(F.lit("E"), (F.col("p_partkey") % 8 + 19999).cast("string"))), F.array(F.concat((F.col("p_partkey") % 30 + 507000).cast("string"), F.lit(" see 12345")), F.lit("x")))
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.flatten(rows)).alias("cell"))
    return cells.select("id", F.explode(references.error_codes(F.col("cell"))).alias("code")).distinct()


_NAMES = "names AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'DispatchGather' || p_partkey % 5 || 'Inner' WHEN 1 THEN 'npuMoeCombine' || p_partkey % 6 WHEN 2 THEN 'enable_part' || p_partkey % 9 ELSE 'token_sort_reduce' || p_partkey % 3 END AS name FROM part)"


def _names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("DispatchGather"), _mod("p_partkey", 5), F.lit("Inner"))).when(k % 4 == 1, F.concat(F.lit("npuMoeCombine"), _mod("p_partkey", 6))).when(k % 4 == 2, F.concat(F.lit("enable_part"), _mod("p_partkey", 9))).otherwise(F.concat(F.lit("token_sort_reduce"), _mod("p_partkey", 3)))
    return table(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"))


def _table(spark, sf_dir):
    sources = _names(spark, sf_dir).select(_mod("id", 3).alias("version"), F.concat(F.lit("x = "), "name", F.lit("(1)")).alias("content"))
    return symbols.symbol_table(symbols.extract_symbols(sources))


@query(
    f"""WITH {_NAMES} SELECT lower(name) AS key, min(name) AS name, CASE id % 4 WHEN 2 THEN 'feature' ELSE 'kernel' END AS kind, (CASE id % 4 WHEN 1 THEN 3.0 WHEN 2 THEN 1.8 ELSE 2.5 END)::DOUBLE AS weight,
  list_sort(list(DISTINCT (id % 3)::VARCHAR)) AS versions FROM names WHERE id % 4 <> 0 GROUP BY lower(name), id % 4"""
)
def symbol_extract(spark, sf_dir):
    """The symbol table of source lines in three versions."""
    return _table(spark, sf_dir)


@query(f"WITH {_NAMES} SELECT id, CASE id % 4 WHEN 0 THEN 'dispatch_gather' || id % 5 WHEN 1 THEN 'npu_moe_combine' || id % 6 ELSE name END AS norm FROM names")
def symbol_normalize(spark, sf_dir):
    return _names(spark, sf_dir).select("id", symbols.normalised(F.col("name")).alias("norm"))


@query(f"WITH {_NAMES} SELECT id, lower(name) AS name, CASE id % 4 WHEN 2 THEN 'feature' ELSE 'kernel' END AS kind, (CASE id % 4 WHEN 1 THEN 3.0 WHEN 2 THEN 1.8 ELSE 2.5 END)::DOUBLE AS weight FROM names WHERE id % 4 <> 0")
def symbol_match(spark, sf_dir):
    """Reports that hold a symbol, matched by token with the table."""
    reports = _names(spark, sf_dir).select("id", F.concat(F.lit("error in "), "name", F.lit(": stop")).alias("text"))
    return symbols.match_symbols(reports, _table(spark, sf_dir)).drop("place")


_TITLES = "titles AS (SELECT o_orderkey AS id, 'Crash in Vector' || o_orderkey % 7 || ' Core' || chr((65 + o_orderkey % 3)::INT) || chr((65 + o_orderkey % 3)::INT) || ' on NPU' || o_orderkey % 4 || ' with some_flag' || o_orderkey % 5 AS title FROM orders)"


def _titles(spark, sf_dir):
    letter = F.chr(F.col("o_orderkey") % 3 + 65)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Crash in Vector"), _mod("o_orderkey", 7), F.lit(" Core"), letter, letter, F.lit(" on NPU"), _mod("o_orderkey", 4), F.lit(" with some_flag"), _mod("o_orderkey", 5)).alias("title"))


@query(
    f"""
WITH {_TITLES}, w AS (SELECT id, list_filter(regexp_split_to_array(title, '[\\s,;:()\\[\\]{{}}<>/|&+=]+'), lambda t: length(t) >= 3 AND regexp_full_match(t, '(?:[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+|[A-Z]{{2,}}[0-9]*|[A-Z][a-z]{{2,}})')) AS w FROM titles),
p AS (SELECT id, w, list_transform(list_filter(range(1, len(w)), lambda i: regexp_matches(w[i], '^[A-Z]') AND regexp_matches(w[i + 1], '^[A-Z]')), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w WHERE len(w) > 0),
d AS (SELECT unnest(list_distinct(list_concat(w, b))) AS word FROM p)
SELECT word, count(*) AS docs, round(count(*) * (ln((SELECT count(*) FROM p) / count(*)) + 1), 6) AS score FROM d GROUP BY word ORDER BY score DESC, word LIMIT 300"""
)
def signal_words_top(spark, sf_dir):
    """The words and pairs of words that titles have most to say with: a report of 300."""
    return symbols.signal_words(_titles(spark, sf_dir)).select("word", "docs", F.round("score", 6).alias("score"))


@query("SELECT 'error driver call ' || chr((97 + k)::INT) || chr((97 + k)::INT) || ' failed' AS phrase, round(least(1.5, 0.8 + 0.1 * 4), 6)::DOUBLE AS weight FROM range(6) t(k)")
def error_phrase_learning(spark, sf_dir):
    """What stands four times in a report is learned."""
    letter = F.chr(F.col("p_partkey") % 6 + 97)
    line = F.concat(F.lit("ERROR driver call "), letter, letter, F.lit(" failed\n"))
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("start\n"), F.repeat(line, 4), F.lit("once: error code\n")).alias("text"))
    return symbols.learned_phrases(texts).withColumn("weight", F.round("weight", 6))


@query("SELECT p_partkey AS source_id, p_name AS title FROM part WHERE contains(lower(p_name), 'a') ORDER BY length(p_name), p_partkey LIMIT 20")
def title_contains(spark, sf_dir):
    """A report of twenty titles, shortest first."""
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("component"))
    return title_search(docs, "a").select("source_id", "title")


@query("SELECT p_partkey AS source_id, p_name AS title FROM part WHERE starts_with(lower(p_name), 'part#1') ORDER BY length(p_name), p_partkey LIMIT 20")
def title_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("component"))
    return title_search(docs, "Part#1", prefix=True).select("source_id", "title")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Body ' || o_orderkey ELSE 'Body ' || o_orderkey || ' only' END AS body, CASE WHEN o_orderkey % 3 = 0 THEN '### Your current environment' || chr(10) || 'pip list' ELSE '' END AS environment FROM orders")
def env_section_split(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit(" Body "), k.cast("string"), F.when(k % 3 == 0, "\n\n### Your current environment\npip list\n").otherwise(" only \n"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), canonical.semantic_body(text).alias("body"), canonical.environment(text).alias("environment"))


@query("SELECT o_orderkey AS id, (['bug', 'fix', 'doc', 'feature', 'rfc', 'other', 'other'])[o_orderkey % 7 + 1] AS kind FROM orders")
def kind_from_title(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (" [Bug] x", "[FIX]: y", "[doc]", "[Feature] a", "[RFC] b", "bug: c", "x [bug]")])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), canonical.title_kind(F.get(names, (F.col("o_orderkey") % 7).cast("int"))).alias("kind"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '0.' || o_orderkey % 12 || CASE WHEN o_orderkey % 3 = 0 THEN '.1' ELSE '' END END AS version FROM orders")
def label_version_first(spark, sf_dir):
    k = F.col("o_orderkey")
    labels = F.array(F.lit("bug"), F.lit("need 3.5"), F.when(k % 2 == 0, F.concat(F.lit("seen: v0."), _mod("o_orderkey", 12), F.when(k % 3 == 0, ".1").otherwise(".x"))).otherwise("other"), F.when(k % 2 == 0, F.lit("v0.99")).otherwise("none"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), canonical.label_version(labels).alias("version"))


SPECS = {"engine": (("engine", "core engine"), r"0\.\d+\.\d+"), "runtime": (("run-time", "runtime"), r"\d+\.\d+(?:\.\d+)?(?:\.?rc\d+)?"), "driver": (("driver",), r"\d+\.\d+(?:\.\d+)?")}


@query("SELECT o_orderkey AS id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [{'component': 'engine', 'version': '0.' || o_orderkey % 9 || '.1'}, {'component': 'runtime', 'version': '8.' || o_orderkey % 5 || '.RC2'}] ELSE [{'component': 'engine', 'version': '0.' || o_orderkey % 9 || '.1'}] END, recursive := true) FROM orders")
def component_versions(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("**Engine version**: v0."), _mod("o_orderkey", 9), F.lit(".1, "), F.when(k % 2 == 0, F.concat(F.lit("Run-Time 8."), _mod("o_orderkey", 5), F.lit(".RC2"))).otherwise("mydriver 1.2.3"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.explode(canonical.component_versions(text, SPECS)).alias("component", "version"))


@query("SELECT page_id, CASE WHEN length(html) > 6000 THEN substr(html, 1, 6000) || chr(10) || '... (truncated)' ELSE html END AS text FROM pages")
def file_truncate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", truncated(F.col("html"), 6000).alias("text"))


@query("SELECT page_id, unnest([{'ref': url, 'kind': 'remote'}, {'ref': 'data:image/png;base64,QUJD', 'kind': 'base64'}, {'ref': 'img/' || page_id || '.png', 'kind': 'local'}, {'ref': 'data:text/x', 'kind': 'unresolved'}], recursive := true) FROM pages")
def image_refs_extract(spark, sf_dir):
    """Image references of a Markdown text for each page."""
    text = F.concat(F.lit("a ![x]("), "url", F.lit(") ![](data:image/png;base64,QUJD)\n![y](img/"), F.col("page_id").cast("string"), F.lit('.png "t") ![z](data:text/x)'))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(references.image_references(text)).alias("r")).select("page_id", "r.ref", "r.kind")
