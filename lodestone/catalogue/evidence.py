"""The evidence graph and the source trees, on tables that stand for them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import symbols
from ..operators import code, graph
from ..operators.code_index import CodeIndex
from ..operators.stored import shared_folder
from .registry import registry, table

QUERIES, ORACLES, query = registry()


def _tables(spark, sf_dir):
    """Orders as issues, line items as change requests that fix them, ship months as releases, parts as entities."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    request = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    issues = orders.select(F.col("o_orderkey").cast("string").alias("id"))
    requests = items.select(request.alias("id"))
    fixes = items.where("l_linenumber <= 3").select(request.alias("src"), F.col("l_orderkey").cast("string").alias("dst"))
    merged = items.where("l_returnflag <> 'N'").select(request.alias("src"), F.date_format("l_shipdate", "yyyy-MM").alias("dst"))
    releases = items.where("l_returnflag <> 'N'").select(F.date_format("l_shipdate", "yyyy-MM").alias("id"), F.date_trunc("month", "l_shipdate").cast("timestamp").alias("date")).distinct()
    mentions = items.select(request.alias("src"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("dst"))
    return issues, requests, fixes, merged, releases, mentions


_T = """
fixes AS (SELECT l_orderkey || '-' || l_linenumber AS src, l_orderkey::VARCHAR AS dst FROM lineitem WHERE l_linenumber <= 3),
merged AS (SELECT l_orderkey || '-' || l_linenumber AS src, strftime(l_shipdate, '%Y-%m') AS dst, date_trunc('month', l_shipdate)::TIMESTAMP AS date FROM lineitem WHERE l_returnflag <> 'N'),
mentions AS (SELECT l_orderkey || '-' || l_linenumber AS src, 'part' || l_partkey AS dst FROM lineitem)"""


@query(f"WITH {_T.lstrip()} SELECT f.dst AS issue, f.src AS request, m.dst AS tag, m.date AS date, m.dst IS NOT NULL AS released FROM fixes f LEFT JOIN merged m USING (src) JOIN orders ON o_orderkey::VARCHAR = f.dst")
def chain_issue(spark, sf_dir):
    """Every issue with its fixes and the releases that have them."""
    issues, _, fixes, merged, releases, _ = _tables(spark, sf_dir)
    return graph.chain(issues, fixes, merged, releases)


@query(f"WITH {_T.lstrip()} SELECT f.dst AS issue, bool_or(m.dst IS NOT NULL) AS released, count(DISTINCT f.src) AS requests FROM fixes f LEFT JOIN merged m USING (src) GROUP BY 1")
def issue_released(spark, sf_dir):
    issues, _, fixes, merged, releases, _ = _tables(spark, sf_dir)
    return graph.released_issues(graph.chain(issues, fixes, merged, releases))


@query(f"WITH {_T.lstrip()} SELECT f.src AS request, list(DISTINCT f.dst) AS issues, coalesce(list_sort(list(DISTINCT m.dst) FILTER (m.dst IS NOT NULL)), []) AS releases FROM fixes f LEFT JOIN merged m USING (src) GROUP BY 1")
def fixes_pr(spark, sf_dir):
    _, _, fixes, merged, _, _ = _tables(spark, sf_dir)
    return graph.fixed_by_request(fixes, merged)


@query(f"WITH {_T.lstrip()}, d AS (SELECT DISTINCT dst AS entity, src AS id FROM mentions) SELECT entity, id, row_number() OVER (PARTITION BY entity ORDER BY id)::INT AS place FROM d QUALIFY place <= 5")
def sig_lookup(spark, sf_dir):
    """A report: of each entity the first five documents that mention it."""
    *_, mentions = _tables(spark, sf_dir)
    return graph.documents_of(mentions, mentions.select(F.col("dst").alias("id")).distinct(), 5)


@query(f"WITH {_T.lstrip()} SELECT src AS doc, 'fixes' AS edge, dst AS entity FROM fixes UNION SELECT src, 'mentions', dst FROM mentions")
def doc_neighbors(spark, sf_dir):
    _, requests, fixes, _, _, mentions = _tables(spark, sf_dir)
    return graph.neighbours(requests, ("mentions", mentions), ("fixes", fixes))


@query("SELECT 50 || (1000 + l_partkey % 40) AS entity, o_orderkey::VARCHAR AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def docs_for_code(spark, sf_dir):
    """Which manuals (finished orders) define each error code."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    documents = items.select(F.col("l_orderkey").cast("string").alias("src"), F.concat(F.lit("50"), (F.col("l_partkey") % 40 + 1000).cast("string")).alias("dst"))
    finished, codes = orders.select(F.col("o_orderkey").cast("string").alias("id")), documents.select(F.col("dst").alias("id")).distinct()
    return graph.edges_between(documents, finished, codes).select(F.col("dst").alias("entity"), F.col("src").alias("id"))


@query(f"WITH {_T.lstrip()} SELECT DISTINCT src, dst FROM mentions WHERE dst IN (SELECT 'part' || p_partkey FROM part WHERE p_size > 20) AND src IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_quantity > 10)")
def edge_referential_filter(spark, sf_dir):
    *_, mentions = _tables(spark, sf_dir)
    parts = table(spark, sf_dir, "part").where("p_size > 20").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"))
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    return graph.edges_between(mentions, parts.unionByName(items))


@query(
    f"""WITH {_T.lstrip()} SELECT 'node' AS kind, 'issue' AS label, count(DISTINCT o_orderkey) AS n FROM orders UNION ALL SELECT 'node', 'release', count(DISTINCT dst) FROM merged
UNION ALL SELECT 'edge', 'fixes', count(*) FROM (SELECT DISTINCT src, dst FROM fixes) UNION ALL SELECT 'edge', 'mentions', count(*) FROM (SELECT DISTINCT src, dst FROM mentions)"""
)
def graph_stats(spark, sf_dir):
    issues, _, fixes, _, releases, mentions = _tables(spark, sf_dir)
    return graph.statistics({"issue": issues, "release": releases}, {"fixes": fixes, "mentions": mentions})


def _sources(spark, sf_dir):
    """Pages as files of four versions."""
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 4).cast("string").alias("version"), F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.lit(".py")).alias("path"), F.replace("html", F.lit(">"), F.lit(">\n")).alias("content"))


_LINES = "lines AS (SELECT (page_id % 4)::VARCHAR AS version, 'src/p' || page_id || '.py' AS path, unnest(l) AS text, generate_subscripts(l, 1)::INT AS line FROM (SELECT page_id, regexp_split_to_array(replace(html, '>', '>' || chr(10)), '\\r\\n|\\n|\\r') AS l FROM pages))"


@query(f"WITH {_LINES} SELECT version, path, line FROM lines WHERE contains(lower(text), 'script') ORDER BY version, path, line LIMIT 50")
def grep_lines(spark, sf_dir):
    """A report of the first fifty lines with a word."""
    return code.grep(symbols.source_lines(_sources(spark, sf_dir)), "SCRIPT", 50).select("version", "path", "line")


@query(f"WITH {_LINES} SELECT version, path, line FROM lines WHERE contains(lower(text), 'class') QUALIFY row_number() OVER (PARTITION BY version ORDER BY path, line) <= 20")
def grep_per_version(spark, sf_dir):
    return code.grep(symbols.source_lines(_sources(spark, sf_dir)), "class", 20, per_version=True).select("version", "path", "line")


def _code(spark, sf_dir):
    """A source file for each part, with a function and a class."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("import x\n\ndef run_"), (k % 9).cast("string"), F.lit("(a):\n    pass\n\nclass Part"), (k % 5).cast("string"), F.lit(":\n  y = gather_combine\n"))
    return table(spark, sf_dir, "part").select((k % 3).cast("string").alias("version"), F.concat(F.lit("f"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("content"))


_SYMBOLS = """
sym AS (SELECT (p_partkey % 3)::VARCHAR AS version, 'f' || p_partkey || '.py' AS path, unnest([{'symbol': 'run_' || p_partkey % 9, 'line': 3, 'snippet': 'def run_' || p_partkey % 9 || '(a):'},
  {'symbol': 'part' || p_partkey % 5, 'line': 6, 'snippet': 'class Part' || p_partkey % 5 || ':'}, {'symbol': 'gather_combine', 'line': 7, 'snippet': 'y = gather_combine'}], recursive := true) FROM part)"""


@query(f"WITH {_SYMBOLS.lstrip()} SELECT * FROM sym")
def code_symbols(spark, sf_dir):
    return symbols.code_symbols(_code(spark, sf_dir))


@query(f"WITH {_SYMBOLS.lstrip()} SELECT version, path, line FROM sym WHERE symbol = 'part3' AND version = '1'")
def symbol_lookup(spark, sf_dir):
    return code.lookup(symbols.code_symbols(_code(spark, sf_dir)), "Part3", ["1"]).select("version", "path", "line")


@query(f"WITH {_SYMBOLS.lstrip()} SELECT version, symbol, path, line FROM sym WHERE version IN ('1', '2')")
def code_index_symbols(spark, sf_dir):
    """All versions indexed and stored, one of them a second time; then the symbols of two of them."""
    index = CodeIndex(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/code-{uuid.uuid4().hex}")
    files = _code(spark, sf_dir).withColumn("repo", F.lit("own"))
    index.add(files, excluded=())
    index.add(files.where("version = '2'"), excluded=())
    return index.symbols("own", ["1", "2"]).select("version", "symbol", "path", "line")


@query(f"WITH {_SYMBOLS.lstrip()} SELECT version, path, line, 'symbol' AS stage FROM sym WHERE symbol = 'run_4' ORDER BY version, path, line LIMIT 50")
def code_two_stage(spark, sf_dir):
    """A word that is a symbol is answered by its rows; the lines would only be searched without."""
    files = _code(spark, sf_dir)
    return code.two_stage(symbols.code_symbols(files), symbols.source_lines(files), "run_4", 50).select("version", "path", "line", "stage")


@query("WITH d AS (SELECT doc_id % 20 AS path, source, unnest(string_split(text, chr(10))) AS text FROM documents WHERE source IN ('src0', 'src1')), a AS (SELECT DISTINCT 'p' AS path, text FROM d WHERE source = 'src0'), b AS (SELECT DISTINCT 'p' AS path, text FROM d WHERE source = 'src1') SELECT path, text, 'removed' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT path, text, 'added' FROM (FROM b EXCEPT FROM a)")
def version_line_diff(spark, sf_dir):
    """The lines of one source's documents and another's, as two versions of a file."""
    lines = table(spark, sf_dir, "documents").select("source", F.lit("p").alias("path"), F.explode(F.split("text", "\n")).alias("text"))
    return code.changed_lines(lines.where("source = 'src0'"), lines.where("source = 'src1'"))


@query()
def unified_diff(spark, sf_dir):
    """Each part's file in two versions."""
    files = _code(spark, sf_dir).select("path", F.col("content").alias("old"), F.replace("content", F.lit("pass"), F.lit("return a")).alias("new"))
    return code.unified_diff(files)
