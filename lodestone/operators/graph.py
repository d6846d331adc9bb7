"""The evidence graph as node and edge tables, and its traversals as joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import Segments


def edges_between(edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The different edges (src, dst) whose ends are both nodes (id).

    Where ids of the two ends' kinds may be equal, ``targets`` has the nodes that edges lead to, ``nodes`` those they come from.
    """
    ends = nodes if targets is None else targets
    return edges.distinct().join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi")


def chain(issues: DataFrame, fixes: DataFrame, merged_in: DataFrame, releases: DataFrame) -> DataFrame:
    """issue, request, tag, date, released: what fixes an issue, and in which release; those without one come last.

    ``fixes`` has src (request) and dst (issue), ``merged_in`` src (request) and dst (release), ``releases`` id and date.
    """
    steps = issues.select(F.col("id").alias("issue")).join(fixes.select(F.col("src").alias("request"), F.col("dst").alias("issue")), "issue")
    tagged = merged_in.select(F.col("src").alias("request"), F.col("dst").alias("tag")).join(releases.select(F.col("id").alias("tag"), "date"), "tag")
    return steps.join(tagged, "request", "left").select("issue", "request", "tag", "date", F.col("tag").isNotNull().alias("released"))


def released_issues(chains: DataFrame) -> DataFrame:
    """issue, released, requests: whether any fix of an issue is out."""
    return chains.groupBy("issue").agg(F.bool_or("released").alias("released"), F.count_distinct("request").alias("requests"))


def fixed_by_request(fixes: DataFrame, merged_in: DataFrame) -> DataFrame:
    """request, issues, releases: arrays in order."""
    issues = fixes.groupBy(F.col("src").alias("request")).agg(F.array_sort(F.collect_set("dst")).alias("issues"))
    tags = merged_in.groupBy(F.col("src").alias("request")).agg(F.array_sort(F.collect_set("dst")).alias("releases"))
    return issues.join(tags, "request", "left").select("request", "issues", F.coalesce("releases", F.array().cast("array<string>")).alias("releases"))


def documents_of(mentions: DataFrame, entity: DataFrame, limit: int = 20) -> DataFrame:
    """entity, id of the documents that mention an entity, the first of each by id; the limit is held to 1..100."""
    held = mentions.select(F.col("dst").alias("entity"), F.col("src").alias("id")).join(entity.select(F.col("id").alias("entity")), "entity", "left_semi")
    # equal mentions share a place, so all but the first ones go before the rest is made different
    placed = held.withColumn("place", F.dense_rank().over(Window.partitionBy("entity").orderBy("id")))
    return placed.where(F.col("place") <= min(max(limit, 1), 100)).distinct()


def neighbours(docs: DataFrame, *edges: tuple[str, DataFrame]) -> DataFrame:
    """doc, edge, entity over named edge tables."""
    out = None
    for name, table in edges:
        part = docs.select(F.col("id").alias("doc")).join(table.select(F.col("src").alias("doc"), F.col("dst").alias("entity")), "doc").select("doc", F.lit(name).alias("edge"), "entity")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def statistics(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """kind, label, n of the different nodes and edges."""
    out = None
    for kind, tables in (("node", nodes), ("edge", edges)):
        for label, table in tables.items():
            part = table.distinct().agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), "n")
            out = part if out is None else out.unionByName(part)
    return out


#: The labels of nodes and edges.
NODES = ("issue", "request", "document", "release", "operator", "error_code", "model", "version", "interface")
EDGES = ("fixes", "merged_in", "mentions", "documents")


def stated(docs: DataFrame, entities, tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """What each document says by itself, with the document as owner: nodes (issue, request, document), and edges fixes (both
    ends may be unknown), mentions and teaches. Parameters are those of :func:`relations`.
    """
    from ..functions.references import error_codes, fix_references, fixed_by_references, interfaces, source_id

    one_line = F.regexp_replace(F.coalesce("title", F.lit("")), "[\\r\\n]", " ").alias("title")
    body, owner = F.coalesce("body", F.lit("")), F.col("source_id").alias("owner")
    issues, requests = docs.where("source_type = 'github_issue'"), docs.where("source_type = 'github_pr'")
    others = docs.where("source_type not in ('github_issue', 'github_pr')")
    named = lambda references, kind: F.explode(F.array_distinct(F.transform(references, lambda r: source_id(r["repo"], kind, r["number"]))))
    forth = requests.select(owner, F.col("source_id").alias("src"), named(fix_references(body, F.col("repo")), "issue").alias("dst"))
    back = issues.select(owner, named(fixed_by_references(body, F.col("repo")), "pr").alias("src"), F.col("source_id").alias("dst"))
    taught = others.select(owner, F.lit("interface").alias("kind"), F.explode(interfaces(body)).alias("dst"))
    if tables is not None:
        taught = taught.unionByName(tables.join(others.select("source_id"), "source_id", "left_semi").select(owner, F.lit("error_code").alias("kind"), F.explode(error_codes(F.col("cells"))).alias("dst")).distinct())
    # one document says all of its rows, so what it says twice goes where it lies; equal rows of tables are the only ones apart
    return {
        "issue": issues.select(owner, "repo", "number", one_line, "status", "created_at", "resolved_at", "url"),
        "request": requests.select(owner, "repo", "number", one_line, "status", "merged_at", "url"),
        "document": others.select(owner, "source_type", one_line),
        "fixes": forth.union(back),
        "mentions": docs.select(owner, F.explode(F.array_distinct(entities(body))).alias("e")).select("owner", "e.kind", F.col("e.name").alias("dst")),
        "teaches": taught,
    }


def related(said: dict[str, DataFrame], calendar: DataFrame) -> dict[str, DataFrame]:
    """Nodes (node_*) and edges (edge_*) of what documents say, and of release calendars: edges without both ends are left out."""
    from .asof import first_after

    node = lambda name: said[name].withColumnRenamed("owner", "id")
    out = {"node_issue": node("issue"), "node_request": node("request"), "node_document": node("document")}
    fixes = said["fixes"].select("src", "dst")
    out["edge_fixes"] = fixes.join(out["node_request"].select(F.col("id").alias("src")), "src", "left_semi").join(out["node_issue"].select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    merged = said["request"].where("merged_at is not null").select(F.col("owner").alias("source_id"), "repo", F.try_to_timestamp("merged_at").alias("at"))
    released = first_after(merged, calendar.select("repo", "tag", "date"), "at", ["repo"]).where("tag is not null")
    named = F.concat("repo", F.lit(":"), "tag")
    out["edge_merged_in"] = released.select(F.col("source_id").alias("src"), named.alias("dst")).distinct()
    out["node_release"] = calendar.select(named.alias("id"), "repo", "tag", "date", F.coalesce("kind", F.lit("release")).alias("kind")).join(out["edge_merged_in"].select(F.col("dst").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    for name, table in (("edge_mentions", "mentions"), ("edge_documents", "teaches")):
        out[name] = said[table].select(F.col("owner").alias("src"), "kind", "dst").distinct()
    every = said["mentions"].select("kind", "dst").union(said["teaches"].select("kind", "dst")).distinct()
    for kind in ("operator", "error_code", "model", "version", "interface"):
        out[f"node_{kind}"] = every.where(F.col("kind") == kind).select(F.col("dst").alias("id"))
    return out


def relations(docs: DataFrame, calendar: DataFrame, entities, tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """Nodes (node_*) and edges (edge_*) of documents (source_id, source_type, repo, number, title, body, status, created_at,
    resolved_at, merged_at, url), release calendars (repo, tag, date, kind) and manuals' tables (source_id, cells as text).

    ``entities`` is a function of a text column to an array of (kind, name). What fixes what comes from both sides' texts;
    a change request is in the first release after its merge; edges without both ends are left out.
    """
    return related(stated(docs, entities, tables), calendar)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _N = T.StringType(), T.LongType()
#: What is kept of each document, by the document that says it.
STATED = {
    "issue": _struct(owner=_S, repo=_S, number=_N, title=_S, status=_S, created_at=_S, resolved_at=_S, url=_S), "request": _struct(owner=_S, repo=_S, number=_N, title=_S, status=_S, merged_at=_S, url=_S),
    "document": _struct(owner=_S, source_type=_S, title=_S), "fixes": _struct(owner=_S, src=_S, dst=_S), "mentions": _struct(owner=_S, kind=_S, dst=_S), "teaches": _struct(owner=_S, kind=_S, dst=_S),
}


class GraphStore:
    """A graph that follows its documents: what a changed document says is replaced, nothing else is extracted again.

    Edges are kept as they are stated, with unknown ends; which of them have both is a join when the graph is read, so a
    document that comes or goes never makes others' edges wrong. Releases follow from the calendar at that time.
    """

    def __init__(self, spark, path: str):
        self.spark, self.segments = spark, Segments(spark, path, {n: (schema, "owner", "graph") for n, schema in STATED.items()}, thin=True)

    def update(self, docs: DataFrame, entities, tables: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Takes in new or changed documents, whole, and lets go of ``removed`` ones (source_id); in one commit."""
        from .stored import stored

        state = self.segments.state()
        docs = stored(docs, "graph-docs")
        said = stated(docs, entities, tables)
        gone = docs.select("source_id") if removed is None else docs.select("source_id").union(removed.select("source_id"))
        return self.segments.commit(state, {n: self.segments.written(n, t, state) for n, t in said.items()}, {"graph": gone} if state["version"] >= 0 else {})

    def read(self, calendar: DataFrame, version: int | None = None) -> dict[str, DataFrame]:
        """The graph's tables as :func:`relations` gives them."""
        state = self.segments.state(version)
        return related({n: self.segments.read(n, state) for n in STATED}, calendar)


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Node and edge tables as Parquet folders; a mark is written last."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    first = next(iter(tables.values()))
    first.sparkSession.createDataFrame([("built",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/_built")


def is_built(spark, path: str) -> bool:
    """Whether a graph was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_built/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def read(spark, path: str) -> dict[str, DataFrame]:
    """The tables of a graph; none where it isn't built."""
    if not is_built(spark, path):
        return {}
    names = [f"node_{n}" for n in NODES] + [f"edge_{e}" for e in EDGES]
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def built_statistics(spark, path: str) -> DataFrame:
    """kind, label, n, built of a graph; one row that says it isn't built, where there is none."""
    tables = read(spark, path)
    if not tables:
        return spark.createDataFrame([(None, None, None, False)], "kind string, label string, n bigint, built boolean")
    parts = {k: {n.partition("_")[2]: t for n, t in tables.items() if n.startswith(k)} for k in ("node", "edge")}
    return statistics(parts["node"], parts["edge"]).withColumn("built", F.lit(True))


def summary(counts: DataFrame) -> DataFrame:
    """One line of text of the statistics (kind, label, n)."""
    part = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("label", "n")))), lambda s: F.format_string("%s=%d", s["label"], s["n"])), ", ")
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return counts.agg(F.format_string("nodes %d (%s); edges %d (%s)", total("node"), part("node"), total("edge"), part("edge")).alias("line"))


def query(spark, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A SELECT over the tables as views; anything else is refused, inserts behind a WITH as well."""
    bound = _braced(sql, tables)
    _refuse_commands(spark, re.sub(r"\{(\w+)\}", r"\1", bound))
    return spark.sql(bound, **tables)


#: Functions that call any method of the driver's or an executor's machine.
REFLECTION = r"(?i)\b(?:try_)?(?:reflect|java_method)\s*\("


def _refuse_commands(spark, sql: str) -> None:
    """Reads the statement as Spark does, without running it, and looks at every part of its plan."""
    jvm = spark._jvm
    known = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in ("Command", "ParsedStatement")]
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    except Exception as e:  # noqa: BLE001  whatever the parser raises
        raise ValueError(f"no query: {str(e)[:200]}") from e
    if re.search(REFLECTION, sql):
        raise ValueError("only queries are allowed")
    while todo:
        node = todo.pop()
        if any(c.isInstance(node) for c in known):
            raise ValueError("only queries are allowed")
        for parts in (node.children(), node.innerChildren()):
            todo += [parts.apply(i) for i in range(parts.size()) if jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(parts.apply(i))]


def _braced(sql: str, tables: dict[str, DataFrame]) -> str:
    """Names of tables as parameters of the query, so that no view of the session is made or replaced."""
    return re.sub(r"(?<!['\w.])(" + "|".join(map(re.escape, tables)) + r")(?!['\w])", r"{\1}", sql)
