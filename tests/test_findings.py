"""What a review found on odd inputs and larger tables."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lodestone.functions import symbols
from lodestone.functions.text import ACCENTED, PLAIN, fold
from lodestone.operators import companion, fulltext, graph, hybrid, vectors
from lodestone.operators.stored import stored
from lodestone.operators.vector_store import embedded
from lodestone.plans import build, search


def test_edges_whose_kinds_share_ids(spark):
    """An order may have the number of a code; only its own kind says whether it is a node."""
    edges = spark.createDataFrame([("1", "501"), ("501", "502"), ("1", "9")], "src string, dst string")
    orders, codes = spark.createDataFrame([("1",), ("9",)], "id string"), spark.createDataFrame([("501",), ("502",)], "id string")
    assert [(r.src, r.dst) for r in graph.edges_between(edges, orders, codes).collect()] == [("1", "501")]
    assert graph.edges_between(edges, orders.union(codes)).count() == 3


def test_scores_that_differ_beyond_nine_digits(spark):
    none = F.lit(None).cast("int")
    hits = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5 + 1e-11), ("q", "c", 0.5)], "query_id string, chunk_id string, final double")
    hits = hits.withColumns({"doc_id": F.col("chunk_id"), "sim": F.lit(0.4), "resolved": F.lit(False), "v_place": none, "f_place": none})
    order = lambda **o: [r.doc_id for r in hybrid.ordered(hits, "query_id", **o).orderBy("place").collect()]
    assert order() == ["a", "b", "c"] and order(digits=None) == ["b", "a", "c"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_hashed_vectors_stay_where_texts_are(spark, monkeypatch):
    rows = [("a", "Über ab\U0001f600 ab abc ab ab 12"), ("b", ""), ("c", None), ("d", "x"), ("e", "ab ab ab " * 9)]
    docs = spark.createDataFrame([(i, "d", t) for i, t in rows], "chunk_id string, doc_id string, text string")
    got = embedded(docs, "echo", dim=16)
    assert "Exchange" not in plan(got)

    def want(text):
        low, sums = (text or "").lower(), [0.0] * 16
        words = re.findall("[a-z0-9]+", low)
        grams = [(low[i : i + n], 1) for n in (2, 3, 4) for i in range(len(low) - n + 1)] + [("w:" + w, 2) for w in words] + [(f"b:{a} {b}", 3) for a, b in zip(words, words[1:], strict=False)]
        for g, w in grams:
            sums[int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big") % 16] += w
        norm = sum(x * x for x in sums) ** 0.5 or 1.0
        return [x / norm for x in sums]

    def same():
        held = {r.chunk_id: r.embedding for r in got.collect()}
        assert all(abs(x - y) < 1e-6 for i, t in rows for x, y in zip(held[i], want(t), strict=True)) and len(held) == len(rows)

    same()
    # texts cut within runs
    for block in (1, 3, 7):
        monkeypatch.setattr(vectors, "ECHO_BLOCK", block)
        (batch,) = vectors._echo(16, True, "v")([pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [(t or "").lower() for _, t in rows]})])
        assert all(abs(x - y) < 1e-6 for (_, t), v in zip(rows, batch["v"].to_pylist(), strict=True) for x, y in zip(v, want(t), strict=True))


def test_texts_are_searched_as_an_index_is(spark, monkeypatch):
    said = ["a b a b a", "b a", "abc ab", "", None, "É a a a", "ab b"] + ["a c"] * 30 + ["ac ab"] * 30
    chunks = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(said)], "chunk_id string, text string").repartition(3)
    asked = [(1, ["a", "b"]), (2, ["a", "a"]), (3, ["a"]), (4, ["zz", "ab"]), (5, ["zz", "a", "a"]), (6, ["qq"]), (7, []), (8, ["b", "zz", "c"])]
    queries = spark.createDataFrame(asked, "query_id long, tokens array<string>")
    index, lengths, plain = fulltext.postings(chunks), fulltext.token_lengths(chunks), fulltext.texts(chunks)
    for prefix in (False, True):
        places = lambda i, p=prefix: sorted((r.query_id, r.chunk_id, r.tf) for r in fulltext.phrase_places(i, queries, prefix=p).collect())
        assert places(plain) == places(index) != []
    monkeypatch.setattr(fulltext, "CELLS", 20)
    for limit, digits in ((50, 9), (2, 9), (3, None)):
        best = lambda i, n: sorted((r.query_id, r.chunk_id, r.place, round(r["rank"], 9)) for r in fulltext.search(i, n, queries, limit, digits).collect())
        assert best(plain, plain.lengths) == best(index, lengths)
    monkeypatch.setattr(fulltext, "AT_ONCE", 2)
    assert best(plain, plain.lengths) == best(index, lengths)


def test_few_rows_of_a_task_are_kept():
    rows = pa.table({"query": [0] * 30 + [1], "shown": [1.0] * 30 + [0.5], "chunk_id": [f"c{i:02}" for i in range(29, -1, -1)] + ["x"], "rank": [1.0] * 30 + [0.5]})
    kept, least = fulltext._kept(rows, 3, 2, np.zeros(2))
    assert kept["chunk_id"].to_pylist() == ["c00", "c01", "c02", "x"] and least.tolist() == [1.0, 0.0]


def test_blocks_of_vectors_are_compared_in_bounded_memory():
    some = np.random.default_rng(1).standard_normal((16384, 8)).astype(np.float32)
    table = lambda n, i, v: pa.table({i: np.arange(n), v: pa.FixedSizeListArray.from_arrays(some[:n].ravel(), 8).cast(pa.list_(pa.float32()))})
    rows, asked = table(16384, "id", "v"), table(1024, "query_id", "q")
    tracemalloc.start()
    got = vectors._compare(3)(rows, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and got.num_rows == 3072
    assert got.filter(pc.equal(got["query_id"], got["id"])).num_rows == 1024


def test_documents_stay_where_versions_are_weighed(spark):
    v = "struct<major:int,minor:int,patch:int>"
    docs = spark.createDataFrame([(i, i % 3, (0, i % 5, 0), (0, i % 5 + 1, 0)) for i in range(30)], f"doc_id long, component long, low {v}, high {v}")
    few = spark.createDataFrame([(0, 1, "0.1.0"), (0, 0, "0.9.0"), (0, 2, "0.1.0"), (1, 0, "x")], "component long, place int, version string")
    got = companion.effective_version(docs, few)
    assert "hashpartitioning(doc_id" not in plan(got) and "MergeJoin" not in plan(got)
    rows = {r.doc_id: (r.version_ref, r.w) for r in got.collect()}
    assert len(rows) == 20 and rows[0] == rows[6] == ("0.1.0", 1.0)
    assert rows[4] == ("x", 0.5) and rows[24][0] == "0.1.0"


def test_reports_of_a_small_file_are_spread(spark, sf_dir):
    from lodestone.catalogue import texts

    got = texts.signature_extract(spark, sf_dir)
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan(got)


def test_equal_mentions_share_a_place(spark):
    said = [("d1", "x"), ("d1", "x"), ("d2", "x"), ("d2", "x"), ("d3", "x"), ("d1", "y"), ("d1", None), ("d4", "z")]
    mentions, entity = spark.createDataFrame(said, "src string, dst string"), spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "id string")
    got = graph.documents_of(mentions, entity, 2)
    assert sorted(map(tuple, got.select("entity", "id", "place").collect())) == [("x", "d1", 1), ("x", "d2", 2), ("y", "d1", 1)]
    text = plan(got).partition("Physical Plan")[2]
    assert "HashAggregate" not in text[text.index("Window") :]  # nothing is made different before the first ones are taken


def test_places_of_a_build_say_their_document(spark):
    chunks = spark.createDataFrame([("d#0", "d", "a b"), ("e#0", "e", "b")], "chunk_id string, doc_id string, text string")
    got = fulltext.postings(chunks, also=("doc_id",))
    assert sorted(map(tuple, got.collect())) == [("a", "d#0", 0, "d"), ("b", "d#0", 1, "d"), ("b", "e#0", 0, "e")] and "Join" not in plan(got)


def test_spellings_of_words(spark):
    docs = spark.createDataFrame([("a", "MoeGate moe_gate 9MoeGate MoeGate"), ("b", "_MoeGate"), ("c", None)], "id string, text string")
    table = spark.createDataFrame([("moe_gate", "moe_gate", "op", 1.0)], "key string, name string, kind string, weight double")
    got = symbols.match_symbols(docs, table)
    assert sorted((r.id, r.name, round(r.weight, 6), r.place) for r in got.collect()) == [("a", "moe_gate", 1.0, 1), ("a", "moegate", 0.9, 2), ("b", "moegate", 0.9, 1)]


def test_prefixes_are_found_in_one_pass(spark, monkeypatch):
    """Texts go through an automaton once for phrases and once for prefixes; chunks without hits, and slices, change nothing."""
    said = ["aa ab b", "", None, "zz", "ab ab ac", "É aé"] * 4
    chunks = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(said)], "chunk_id string, text string").repartition(2)
    queries = spark.createDataFrame([(1, ["a", "q"]), (2, ["q"]), (3, ["e", "b", "b"])], "query_id long, tokens array<string>")
    plain, passes = fulltext.texts(chunks), []
    real = fulltext._head_hits
    monkeypatch.setattr(fulltext, "_head_hits", lambda shared: passes.append(1) or real(shared))
    monkeypatch.setattr(fulltext, "CELLS", 7)
    got = sorted((r.query_id, r.chunk_id, round(r["rank"], 9)) for r in fulltext.search(plain, plain.lengths, queries).collect())
    index, lengths = fulltext.postings(chunks), fulltext.token_lengths(chunks)
    assert got == sorted((r.query_id, r.chunk_id, round(r["rank"], 9)) for r in fulltext.search(index, lengths, queries).collect()) != []
    assert len(passes) == 1 and {q for q, _, _ in got} == {1, 3}


def test_folding_leaves_no_letter_out(spark):
    every = "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x10000)]))
    rows = spark.createDataFrame([(c,) for c in every] + [("plain",), ("a É b",), (None,)], "t string").select("t", fold(F.col("t")).alias("got"), F.lower(F.translate("t", ACCENTED, PLAIN)).alias("want"))
    assert rows.where("not got <=> want").count() == 0


def test_a_build_writes_texts_as_its_rows_only(spark, tmp_path, monkeypatch):
    """Documents and chunks have no second table of their own, and places of tokens are sorted where they lie."""
    kept = []
    monkeypatch.setattr(build, "stored", lambda df, tag, **o: kept.append(set(df.columns)) or stored(df, tag, **o))
    docs = lambda *rows: spark.createDataFrame(rows, "source_id string, body string, status string")
    path = str(tmp_path / "kb")
    build.ingest_documents(spark, docs(("a", "one two", "open"), ("b", "two", "open"), ("c", "", "open")), path)
    built = build.ingest_documents(spark, docs(("a", "one two", "open"), ("b", "two", "closed"), ("c", "three three", "open"), ("d", "four", "open"), ("d", "four", "open")), path)
    assert kept and not any(k & {"body", "text"} for k in kept)
    places = fulltext.postings(spark.createDataFrame([("a#0", "a", "one two")], "chunk_id string, doc_id string, text string"), also=("doc_id",))
    assert "Exchange" not in plan(build.tables(spark, path).layout["postings"](places))
    assert sorted(map(tuple, built.actions.collect())) == [("a", "skip"), ("b", "refresh"), ("c", "embed"), ("d", "embed")]
    assert sorted(map(tuple, built.index.select("token", "chunk_id", "pos").collect())) == [("four", "d#0", 0), ("one", "a#0", 0), ("three", "c#0", 0), ("three", "c#0", 1), ("two", "a#0", 1), ("two", "b#0", 0)]
    assert "action" not in built.docs.columns and {(r.source_id, r.status) for r in built.docs.collect()} == {("a", "open"), ("b", "closed"), ("c", "open"), ("d", "open")}


def test_signatures_of_many_documents_count_in_all(spark):
    """A document that comes after the first thirty with a signature is found by it; equal documents and titles change nothing."""
    said = [(f"d{i:02}", "RuntimeError: out of memory", "t", "a") for i in range(40)] + [("e1", "ValueError: out of memory\nretCode=507001", "on Out of memory", "a"), ("e2", "retCode=507001", None, "b"), ("e3", "plain", "out of memory", "a")]
    rows = spark.createDataFrame(said, "doc_id string, text string, title string, component string")
    chunks, docs = rows.select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id", "text"), rows.drop("text")
    reports = spark.createDataFrame([(1, "ValueError: out of memory\nretCode=507001"), (2, "ValueError: out of memory\nretCode=507001"), (3, "RuntimeError: out of memory"), (4, "nothing")], "query_id long, text string")
    for index in (fulltext.texts(chunks), fulltext.postings(chunks)):
        got = {(r.query_id, r.place): (r.doc_id, round(r.score, 3), r.signatures) for r in search.signature_search(chunks, docs, index, reports, limit=3).collect()}
        whole = [("e1", 7.2, ["507001", "out of memory", "valueerror"]), ("e2", 3.0, ["507001"]), ("d00", 2.0, ["out of memory"])]
        assert got == {(q, n + 1): x for q in (1, 2) for n, x in enumerate(whole)} | {(3, n + 1): x for n, x in enumerate([("d00", 3.2, ["out of memory", "runtimeerror"]), ("d01", 3.2, ["out of memory", "runtimeerror"]), ("d02", 3.2, ["out of memory", "runtimeerror"])])}
    first = search.signature_search(chunks, docs, fulltext.texts(chunks), reports, per_signature=30, component="a").where("query_id = 1 and doc_id = 'e1'").collect()
    assert [(round(r.score, 3), r.signatures) for r in first] == [(4.2, ["507001", "valueerror"])]
