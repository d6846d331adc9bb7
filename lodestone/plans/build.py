"""The whole build: sources to canonical documents, chunks, full-text index, vectors and graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import symbols
from ..functions.references import mentions
from ..functions.signatures import extract_signatures
from ..operators import chunking, fulltext, graph, ingest
from ..operators.code import indexed_sources
from ..operators.code_index import EXTENSIONS
from ..operators.segments import Cache, Segments
from ..operators.stored import stored
from ..operators.vector_store import ReadOnly, VectorStore, embedded
from ..sources import sinks
from ..sources.registry import build_sources, collect, conformed, exists, symbol_tables
from ..sources.schema import CANONICAL

#: What vectors are made of, and all that a document is known by.
EMBED, EVERY = ("source_id", "title", "body"), ("source_id", "title", "body", "status", "resolved_at", "version_min", "version_max", "component", "kind", "verification")
#: Row groups and pages of postings are small, so that a search reads those of its tokens and not much else.
POSTING_BYTES, POSTING_ROWS = 4 << 20, 2000


_S = T.StringType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: Schema, key and group of each table. A document that changes in other fields than its text has only its row replaced.
TABLES = {
    "docs": (T.StructType([*CANONICAL, *_schema(embed_hash=_S, meta_hash=_S)]), "source_id", "docs"),
    "chunks": (_schema(doc_id=_S, chunk_id=_S, seq=T.IntegerType(), text=_S), "doc_id", "text"),
    "postings": (_schema(token=_S, chunk_id=_S, pos=T.IntegerType(), doc_id=_S), "doc_id", "text"),
    "lengths": (_schema(chunk_id=_S, dl=T.IntegerType(), doc_id=_S), "doc_id", "text"),
    "vectors": (_schema(chunk_id=_S, doc_id=_S, embedding=T.ArrayType(T.FloatType()), meta=T.MapType(_S, _S)), "doc_id", "text"),
}
#: What a build does with a document, written beside its row.
ACTION = _schema(action=_S)


@dataclass(frozen=True)
class Built:
    """The tables of one version of a build, and what it did with each document (source_id, action)."""

    docs: DataFrame
    chunks: DataFrame
    index: DataFrame
    lengths: DataFrame
    vectors: VectorStore
    actions: DataFrame
    version: int = 0


class Frozen:
    """What a vector store reads from: the rows of one version."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def read(self) -> DataFrame:
        return self.rows


def tables(spark: SparkSession, path: str) -> Segments:
    """The segments of the build under ``path``. Postings stay with their chunks, and are sorted by token in each file.

    They are several times as large as the texts, so they aren't dealt out by token: each file has all tokens of its chunks.
    """
    by_token = lambda df: df.sortWithinPartitions("token", "chunk_id", "pos")
    options = {name: {"compression": "zstd"} for name in TABLES}
    options["postings"] |= {"parquet.block.size": str(POSTING_BYTES), "parquet.page.row.count.limit": str(POSTING_ROWS)}
    return Segments(spark, path, TABLES, {"postings": by_token}, options)


def build(spark: SparkSession, configs: Sequence[Mapping], path: str, rebuild: bool = False, limit: int | None = None, provider: Callable | str = "echo", buckets: int = 64) -> Built:
    """Takes in the documents of the sources ``configs``; only those that are new or changed are cut and embedded again.

    ``rebuild`` starts from nothing, ``limit`` takes the first documents by id. A document that comes without a body keeps no
    chunks. Of one id the document of the source named first counts.
    """
    docs = sinks.unique(collect(spark, build_sources(configs)))
    if limit is not None:
        docs = docs.orderBy("source_id").limit(limit)
    return ingest_documents(spark, docs, path, rebuild, provider, buckets)


def ingest_documents(spark: SparkSession, docs: DataFrame, path: str, rebuild: bool = False, provider: Callable | str = "echo", buckets: int = 64, cache: str | None = None) -> Built:
    """The same from canonical documents: rebuilds from them, or takes in what changed.

    All tables change in one commit at the end: a build that fails leaves the version before, and one that starts while
    another commits ends with :class:`Conflict`. What is written is in proportion to what came in. Texts that were ever embedded by
    the provider (known as ``cache``, or by its name) aren't embedded again. ``buckets`` is not used any more.
    """
    path = path.rstrip("/")
    store = tables(spark, path)
    state = store.state()
    fresh_start = rebuild or state["version"] < 0
    base = {**state, "segments": {}, "gone": {}} if rebuild else state
    docs = conformed(docs)
    incoming = ingest.hashed(sinks.unique(docs), EMBED, EVERY)
    held = store.read("docs", base).select("source_id", "embed_hash", "meta_hash")
    planned = ingest.plan(incoming, held, "source_id")
    # texts are written as rows of the commit only; what is made of them is read from there
    added = {"docs": store.written("docs", planned.where("action <> 'skip'"), state, ACTION)}
    changed = store.fresh("docs", added["docs"], ACTION)
    again = changed.where("action = 'embed'")
    added["chunks"] = store.written("chunks", chunking.chunk_documents(again), state)
    chunks = store.fresh("chunks", added["chunks"])
    added["postings"] = store.written("postings", fulltext.postings(chunks, also=("doc_id",)), state)
    added["lengths"] = store.written("lengths", chunks.select("chunk_id", fulltext.token_count(F.col("text")).alias("dl"), "doc_id"), state)
    added["vectors"] = store.written("vectors", _vectors(spark, chunks, path, provider, cache), state)
    skipped = docs.select("source_id").distinct().join(held, "source_id", "left_semi").join(changed, "source_id", "left_anti")
    actions = stored(changed.select("source_id", "action").unionByName(skipped.select("source_id", F.lit("skip").alias("action"))), "actions")
    gone = {} if fresh_start else {"docs": changed.select("source_id"), "text": again.select("source_id")}
    version = store.commit(base | {"version": state["version"]}, added, gone)
    return replace(opened(spark, path, version=version), actions=actions)


def _vectors(spark: SparkSession, chunks: DataFrame, path: str, provider: Callable | str, cache: str | None) -> DataFrame:
    """chunk_id, doc_id, embedding, meta of chunks. Hashed n-grams are made anew; other providers see a text once."""
    if isinstance(provider, str):
        return embedded(chunks.select("chunk_id", "doc_id", "text"), provider)
    known = Cache(spark, f"{path}/embedded", cache or f"{getattr(provider, '__module__', '')}.{getattr(provider, '__qualname__', type(provider).__qualname__)}".replace("<", "").replace(">", ""))
    ask = lambda new: embedded(new.select(F.hex("hash").alias("chunk_id"), F.lit("").alias("doc_id"), "text"), provider).select(F.unhex("chunk_id").alias("hash"), "embedding")
    found = known.filled(chunks.select("text"), ask)
    return chunks.withColumn("hash", Cache.hash(F.col("text"))).join(found, "hash").select("chunk_id", "doc_id", "embedding", F.create_map().cast("map<string,string>").alias("meta"))


def opened(spark: SparkSession, path: str, read_only: bool = True, version: int | None = None) -> Built:
    """A build under ``path``, the last one or one that is named: all its tables are of one version.

    Vectors are open for reading; they change by builds only. Actions are those of documents since the version before.
    """
    path = path.rstrip("/")
    store = tables(spark, path)
    if not store.versions():
        raise FileNotFoundError(f"nothing is built under {path}")
    if not read_only:
        raise ReadOnly("the tables of a build change by builds only")
    state = store.state(version)
    read = lambda name: store.read(name, state)
    held = VectorStore(spark, f"{path}/vectors", read_only=True)
    held.files = Frozen(read("vectors"))
    none = spark.createDataFrame([], "source_id string, action string")
    return Built(read("docs").withColumn("doc_id", F.col("source_id")), read("chunks"), read("postings").select("token", "chunk_id", "pos"), read("lengths").select("chunk_id", "dl"), held, none, state["version"])


def undo(spark: SparkSession, path: str, version: int) -> Built:
    """Goes back to an older version, as a new one; whatever came after stays readable by its number."""
    tables(spark, path).restore(version)
    return opened(spark, path)


def build_graph(spark: SparkSession, docs: DataFrame, calendar: DataFrame, path: str, tables: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Writes the graph of canonical documents (with repo, number, merged_at) and gives its statistics."""
    docs = docs if limit is None else docs.orderBy("source_id").limit(limit)
    graph.write(graph.relations(docs, calendar, lambda text: mentions(extract_signatures(text)), tables), path)
    return graph.built_statistics(spark, path)


def symbol_table(spark: SparkSession, saved: str, sources: DataFrame, issues: DataFrame) -> DataFrame:
    """key, name, kind, weight, versions: the symbol table saved under ``saved``; where there is none, or a broken one, it is made.

    It is then made of source trees (version, path, content) and of the titles and bodies of issues (source_id, title, body),
    and not written.
    """
    if exists(spark, saved):
        table = symbol_tables(spark, saved)
        if not table.isEmpty():
            return table
    phrases = symbols.phrase_symbols(symbols.learned_phrases(issues, id_col="source_id", text_col="body"))
    found = symbols.extract_symbols(indexed_sources(sources, extensions=EXTENSIONS)).unionByName(symbols.title_mentions(issues)).unionByName(phrases)
    return symbols.symbol_table(found)
