"""Vector store, build, graph, loaders, component-aware search, symbols, parsers."""

import ast
import glob
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing, signatures, symbols
from lodestone.functions.text import search_tokens
from lodestone.operators import chunking, companion, fulltext, graph, review
from lodestone.operators.canonical import canonical_documents
from lodestone.operators.vector_store import Breaker, ReadOnly, VectorStore, embedded
from lodestone.plans import build, search
from lodestone.sources import registry, sinks


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), buckets=4)
    rows = lambda *r: spark.createDataFrame([(c, d, [1.0, float(x)], {"k": k}) for c, d, x, k in r], "chunk_id string, doc_id string, embedding array<float>, meta map<string,string>")
    held = lambda s: {r.chunk_id: (r.doc_id, r.embedding[1], r.meta["k"]) for r in s.read().collect()}
    assert store.count() == 0
    store.add(rows(("a#0", "a", 1, "x"), ("a#1", "a", 2, "x"), ("b#0", "b", 3, "y"), ("c#0", "c", 4, "z")))
    store.add(rows(("b#0", "b", 9, "y"), ("b#0", "b", 9, "y")))
    assert held(store) == {"a#0": ("a", 1, "x"), "a#1": ("a", 2, "x"), "b#0": ("b", 9, "y"), "c#0": ("c", 4, "z")}
    store.delete(spark.createDataFrame([("a",), ("a",), ("nobody",)], "doc_id string"))
    store.update_meta(spark.createDataFrame([("c", {"k": "new"})], "doc_id string, meta map<string,string>"))
    assert held(store) == {"b#0": ("b", 9, "y"), "c#0": ("c", 4, "new")}
    store.replace(spark.createDataFrame([("b",), ("d",)], "doc_id string"), rows(("b#5", "b", 7, "q")))
    again = VectorStore(spark, str(tmp_path / "v"), read_only=True, buckets=4)
    assert held(again) == {"b#5": ("b", 7, "q"), "c#0": ("c", 4, "new")}
    store.files.vacuum()
    assert held(again) == {"b#5": ("b", 7, "q"), "c#0": ("c", 4, "new")}
    for write in (lambda: again.add(rows()), lambda: again.delete(rows()), lambda: again.update_meta(rows()), again.clear, lambda: again.replace(rows(), rows())):
        with pytest.raises(ReadOnly):
            write()
    store.clear()
    assert again.count() == 0


def test_embedding_batches(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "word " * (i % 3), str(i)) for i in range(150)], "chunk_id string, doc_id string, text string, label string").coalesce(1)
    got = embedded(chunks, lambda texts: [[float(len(texts)), float(len(t))] for t in texts], batch=64).collect()
    assert {r.embedding[0] for r in got} == {64.0, 22.0} and all(r.meta == {"label": r.chunk_id[1:]} for r in got)
    echo = {r.chunk_id: r.embedding for r in embedded(chunks).collect()}
    assert len(echo) == 150 and sum(x * x for x in echo["c1"]) == pytest.approx(1, abs=1e-5) and set(echo["c0"]) == {0.0}
    with pytest.raises(ValueError):
        embedded(chunks, "nothing")


def test_breaker():
    now, calls = [0.0], []

    def call(text):
        calls.append(text)
        if text == "bad":
            raise OSError
        return [1.0]

    ask = Breaker(call, lambda: now[0])
    assert ask("good") == [1.0] and [ask("bad") for _ in range(3)] == [None] * 3 and ask.open
    assert ask("good") is None and len(calls) == 4
    now[0] = 61
    assert ask("good") == [1.0] and not ask.open


def _demo(spark):
    items, comments = registry.demo_items(spark)
    docs = canonical_documents(items, comments, "own/repo", "engine", {"engine": (("engine",), r"0\.\d+\.\d+")})
    return registry.conformed(docs), docs


def test_build_and_search(spark, tmp_path):
    docs, raw = _demo(spark)
    path = str(tmp_path / "kb")
    first = build.ingest_documents(spark, docs, path, buckets=4)
    assert {r.action for r in first.actions.collect()} == {"embed"} and first.docs.count() == 6 and first.vectors.count() == first.chunks.count() == 6
    with pytest.raises(ReadOnly):
        first.vectors.clear()
    changed = docs.withColumn("body", F.when(F.col("source_id").endswith(":2"), "").otherwise(F.col("body"))).withColumn("status", F.when(F.col("source_id").endswith(":3"), "closed").otherwise(F.col("status")))
    second = build.ingest_documents(spark, changed, path, buckets=4)
    assert {r.source_id.rpartition(":")[2]: r.action for r in second.actions.collect()} == {"1": "skip", "2": "embed", "3": "refresh", "4": "skip", "5": "skip", "6": "skip"}
    assert second.chunks.count() == 5 == second.vectors.count() and second.docs.where("status = 'closed'").count() == 3
    third = build.ingest_documents(spark, docs, path, rebuild=True, buckets=4)
    assert third.vectors.count() == 6 and third.actions.where("action = 'embed'").count() == 6
    texts = spark.createDataFrame([("q", "out of memory"), ("p", "engine:0.5.1 timeout or trap error")], "query_id string, text string")
    found = search.component_search(third.chunks, third.docs, third.index, third.lengths, texts, F.lit("2024-06-01").cast("timestamp"), F.lit("0.6.0")).collect()
    assert {r.query_id: r.doc_id for r in found if r.place == 1} == {"q": "github:own-repo:issue:1", "p": "github:own-repo:issue:2"}
    assert {r.query_id: r.version_ref for r in found} == {"q": "0.6.0", "p": "0.5.1"}
    lines = search.acceptance(search.component_search(third.chunks, third.docs, third.index, third.lengths, texts, F.lit("2024-06-01").cast("timestamp"), F.lit("0.6.0")), third.docs).collect()
    assert any(r.line.startswith("1. [") and "engine runs out of memory" in r.line for r in lines)
    assert search.health(third.vectors.read(), True).first() == ("ok", 6, "open")
    with pytest.raises(FileNotFoundError):
        build.opened(spark, str(tmp_path / "none"))
    files = tmp_path / "md"
    files.mkdir()
    (files / "a.md").write_text("# A head\n![x](pic/a.png) ![y](pic/b.png)")
    whole = build.build(spark, [{"type": "markdown", "path": str(files), "assets": {"pic/a.png": "stored-a.png"}}], str(tmp_path / "kb2"), limit=5, buckets=2)
    assert whole.docs.first().body == "# A head\n![x](stored-a.png) ![y](pic/b.png)"


def test_component_versions_weigh_documents(spark):
    """Each document is weighed against the version that goes with it; by hand, for all kinds of components."""
    docs = spark.createDataFrame([(f"d{i}", c, low, "open", "2024-01-01") for i, (c, low) in enumerate([("a", "0.5"), ("b", "1.1"), ("b", "2.0"), ("z", "9.0")])], "doc_id string, component string, version_min string, status string, created_at string")
    docs = docs.withColumns({"version_max": F.col("version_min"), "resolved_at": F.lit(None).cast("timestamp"), "source_type": F.lit("github_issue"), "kind": F.lit("bug"), "verification": F.lit(None).cast("string"), "created_at": F.col("created_at").cast("timestamp")})
    chunks = spark.createDataFrame([(f"d{i}#0", f"d{i}", "it fails here") for i in range(5)], "chunk_id string, doc_id string, text string")
    index, lengths = fulltext.postings(chunks), fulltext.token_lengths(chunks)
    matrix = spark.createDataFrame([(0, "0.5", "2.0"), (1, "0.5", "1.1"), (2, "0.7", "3.0")], "row_id int, a string, b string")
    cells = companion.unpivoted(matrix, ("a", "b"))
    texts = spark.createDataFrame([("q", "a:0.5 it fails"), ("n", "it fails")], "query_id string, text string")
    run = lambda **o: {(r.query_id, r.doc_id): r.version_ref for r in search.component_search(chunks, docs, index, lengths, texts, F.lit("2024-02-01").cast("timestamp"), F.lit("7.7"), cells=cells, **o).collect()}
    got = run()
    assert got == {("q", "d0"): "0.5", ("q", "d1"): "1.1", ("q", "d2"): "2.0", ("q", "d3"): "7.7", ("q", "d4"): "7.7"} | {("n", f"d{i}"): "7.7" for i in range(5)}
    assert {k for k in run(filter_component=True) if k[0] == "q"} == {("q", "d0")}
    vectors = spark.createDataFrame([("n", "d3#0", 0.9, 1), ("n", "d4#0", 0.1, 2)], "query_id string, chunk_id string, sim double, place int")
    both = {(r.query_id, r.doc_id): (r.src, r.sim) for r in search.component_search(chunks, docs, index, lengths, texts, F.lit("2024-02-01").cast("timestamp"), F.lit("7.7"), vector_hits=vectors).collect()}
    assert both["n", "d3"] == ("both", 0.9) and both["q", "d3"][0] == "fts"


def test_graph(spark, tmp_path):
    _, raw = _demo(spark)
    docs = raw.withColumns({"repo": F.lit("own/repo"), "number": F.regexp_extract("source_id", r"(\d+)$", 1).cast("bigint")})
    manual = spark.createDataFrame([("tables:m", "doc_pdf", "M", "命令格式\nnpu-tool -get")], "source_id string, source_type string, title string, body string")
    docs = docs.unionByName(manual, allowMissingColumns=True)
    cal = spark.createDataFrame([("own/repo", "v0.6.0", "2024-03-01", "release"), ("own/repo", "v0.5.0", "2024-01-01", "release")], "repo string, tag string, date string, kind string").withColumn("date", F.col("date").cast("timestamp"))
    cells = spark.createDataFrame([("tables:m", "E12345 and 507014"), ("other", "E99999")], "source_id string, cells string")
    assert not graph.is_built(spark, str(tmp_path / "g")) and graph.built_statistics(spark, str(tmp_path / "g")).first().built is False
    counts = {(r.kind, r.label): r.n for r in build.build_graph(spark, docs, cal, str(tmp_path / "g"), cells).collect()}
    assert {k: counts["node", k] for k in ("issue", "request", "document", "release")} == {"issue": 5, "request": 1, "document": 1, "release": 1}
    assert counts["edge", "fixes"] == counts["edge", "merged_in"] == 1 and counts["edge", "documents"] == 3
    tables = graph.read(spark, str(tmp_path / "g"))
    got = graph.query(spark, tables, "SELECT i.title, m.dst FROM node_issue i JOIN edge_fixes f ON f.dst = i.id JOIN edge_merged_in m ON m.src = f.src").collect()
    assert [tuple(r) for r in got] == [("[Bug]: engine runs out of memory", "own/repo:v0.6.0")]
    assert ("error_code", "507014") in {(r.kind, r.dst) for r in tables["edge_mentions"].collect()}
    with pytest.raises(ValueError):
        graph.query(spark, tables, "DROP TABLE node_issue")
    line = graph.summary(graph.built_statistics(spark, str(tmp_path / "g"))).first().line
    assert line.startswith("nodes ") and "issue=5" in line and "fixes=1" in line


def test_loaders(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x))
    for d in ("cal", "mat", "sym", "sig", "zips"):
        (tmp_path / d).mkdir()
    put("cal/new.json", {"repo": "o/r", "releases": [{"tag": "v1", "date": "2024-01-01T00:00:00Z", "prerelease": True, "kind": "rc"}, {"tag": "v2", "date": "bad"}, {"tag": None, "date": "2024-01-01"}]})
    put("cal/old.json", {"repo": "o/s", "generated_at": "x", "w1": "2024-02-01T00:00:00Z", "w2": "never"})
    put("cal/broken.json", "{")
    assert {(r.repo, r.tag, r.kind) for r in registry.calendars(spark, str(tmp_path / "cal")).collect()} == {("o/r", "v1", "rc"), ("o/s", "w1", None)}
    put("mat/list.json", [{"a": "1", "b": "2"}, {"a": "3"}])
    assert [(r.row_id, r.a, r.b) for r in registry.companion_matrix(spark, str(tmp_path / "mat/list.json"), ("a", "b")).collect()] == [(0, "1", "2"), (1, "3", None)]
    put("mat/object.json", {"rows": [{"a": "1", "notes": "n"}]})
    assert [(r.a, r.notes) for r in registry.companion_matrix(spark, str(tmp_path / "mat/object.json"), ("a", "b")).collect()] == [("1", "n")]
    table = spark.createDataFrame([("opa", "OpA", "kernel", 3.0, ["v1"]), ("b_c", "b_c", "feature", 1.5, [])], "key string, name string, kind string, weight double, versions array<string>")
    registry.write_symbol_table(table, str(tmp_path / "sym/t"))
    back = registry.symbol_tables(spark, str(tmp_path / "sym/t"))
    assert sorted(map(str, back.select(*table.columns).collect())) == sorted(map(str, table.collect()))
    assert [r.match for r in symbols.lookup(back, "OPA").collect()] == ["name"] and [r.key for r in symbols.by_weight(back).collect()] == ["opa", "b_c"]
    put("sig/w.json", {"words": [{"word": "Vector Core", "count": 2, "docs": 2, "idf": 1.0, "score": 5.0}, {"word": "Abc", "score": 9.0}]})
    put("sig/broken.json", "x")
    assert [r.word for r in registry.signal_words(spark, str(tmp_path / "sig")).collect()] == ["Abc", "Vector Core"]
    for name, top in (("v1", "tree-1/"), ("v2", "")):
        with zipfile.ZipFile(tmp_path / f"zips/{name}.zip", "w") as z:
            z.writestr(f"{top}src/a.py", "def x(): pass")
            z.writestr(f"{top}b.py", "y")
    (tmp_path / "zips/bad.zip").write_text("no archive")
    sources = registry.zipped_sources(spark, str(tmp_path / "zips"))
    assert sorted((r.version, r.path) for r in sources.collect()) == [(v, p) for v in ("v1", "v2") for p in ("b.py", "src/a.py")]
    tagged = sources.withColumn("repo", F.when(F.col("version") == "v1", "r1").otherwise("r2"))
    assert registry.has_version(tagged, "r1", "v1") and not registry.has_version(tagged, "r1", "v2")
    assert registry.in_repository(tagged, "r1", "v1", "b.py").first().content == "y" and registry.in_repository(tagged, "r2", path="none").isEmpty()
    assert [(r.version, r.files) for r in search.code_versions(tagged).collect()] == [("v1", 2), ("v2", 2)] and search.code_versions(tagged, "r2").count() == 1
    raw = spark.createDataFrame([("v1", "2024-01-01T00:00:00Z", False, False), ("v2rc1", "2024-02-01T00:00:00Z", True, False), ("d", "2024-03-01T00:00:00Z", False, True)], "tag_name string, published_at string, prerelease boolean, draft boolean")
    rows = registry.releases(raw)
    assert [(r.tag, r.kind) for r in rows.collect()] == [("v2rc1", "rc"), ("v1", "release")]
    assert [r["tag"] for r in registry.calendar_of("o/r", rows).first()["releases"]] == ["v2rc1", "v1"]


def test_images_and_assets(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for name, data in (("a.png", b"1"), ("b.png", b"1"), ("c.png", b"2"), ("d.png", b"3")):
        (tmp_path / "img" / name).write_bytes(data)
    (tmp_path / "read.json").write_text("\n".join(json.dumps(x) for x in ({"path": "a.png", "text": "RuntimeError: out of memory", "lines": [{"text": "x", "confidence": 0.5}, {"text": "y", "confidence": 1.0}]}, {"path": "c.png", "text": "a cat"}, {"path": "d.png", "text": "retCode=507014"})))
    source = registry.build_sources([{"type": "images", "path": str(tmp_path / "img"), "results": str(tmp_path / "read.json")}])[0]
    got = {r.title: r for r in source.canonicalize(spark).collect()}
    assert set(got) == {"a.png", "d.png"} and got["a.png"].extra["confidence"] == "0.75" and "out of memory" in got["a.png"].body
    source.done = spark.createDataFrame([(got["a.png"].extra["sha"],)], "sha string")
    assert {r.title for r in source.canonicalize(spark).collect()} == {"d.png"}
    files = spark.createDataFrame([("x/a.png", bytearray(b"1")), ("y/a.png", bytearray(b"2")), ("z/a.png", bytearray(b"1"))], "path string, content binary")
    first = registry.copied_assets(spark, files, str(tmp_path / "out"))
    assert all(r.copied for r in first.collect()) and len(glob.glob(str(tmp_path / "out/*.png"))) == 2
    assert not any(r.copied for r in registry.copied_assets(spark, files, str(tmp_path / "out")).collect())


def test_parsed_documents(spark, tmp_path):
    (tmp_path / "a.tables.json").write_text(json.dumps({"source": "man", "text": "page text", "sections": [{"title": "1 Head", "text": "body"}], "tables": [{"page": 1, "index": 0, "rows": [["a"]]}]}))
    (tmp_path / "b.tables.json").write_text(json.dumps({"source": "locked", "encrypted": True, "text": "x"}))
    (tmp_path / "c.tables.json").write_text(json.dumps({"source": "blank", "text": "  "}))
    docs = registry.build_sources([{"type": "parsed_tables", "path": str(tmp_path)}])[0].canonicalize(spark).collect()
    assert [(d.source_id, d.body) for d in docs] == [("tables:man", "page text\n\n## 1 Head\n\nbody\n\n| a |\n|---|")]


def test_first_that_came_in_wins(spark):
    docs = spark.createDataFrame([("a", "late", "2024-01-01", 2), ("a", "first", "2025-01-01", 1), ("b", "x", None, 3)], "source_id string, body string, created_at string, ingest_order int")
    assert {(r.source_id, r.body) for r in sinks.unique(docs).collect()} == {("a", "first"), ("b", "x")}
    assert {(r.source_id, r.body) for r in sinks.unique(docs.drop("ingest_order")).collect()} == {("a", "late"), ("b", "x")}


def test_symbols(spark):
    code = spark.createDataFrame([("v2", "DSA_x dsa_cp kv_offload_meta x_meta kv_cache_meta OTHER_ASCEND_FLAG aclnnFoo enable_part1 copyin dispatch_ffn_combine"), ("v1", "npuMoe aclnnFOO")], "version string, content string")
    got = {(r.name, r.kind, r.weight) for r in symbols.extract_symbols(code).collect()}
    assert got == {("dsa_cp", "kernel", 2.0), ("OTHER_ASCEND_FLAG", "feature", 2.0), ("aclnnFoo", "kernel", 3.0), ("enable_part1", "feature", 1.8), ("dispatch_ffn_combine", "kernel", 2.5), ("npuMoe", "kernel", 3.0), ("aclnnFOO", "kernel", 3.0)}
    titles = spark.createDataFrame([("GLM-5.1 hangs on CANN 8.1 with my-ascend v0.9.1",), (None,)], "title string")
    mentions = symbols.title_mentions(titles)
    assert {(r.name, r.kind) for r in mentions.collect()} == {("GLM-5.1", "model"), ("CANN 8.1", "version"), ("my-ascend v0.9.1", "version")}
    phrase = symbols.phrase_symbols(spark.createDataFrame([("vector core timeout", 1.1)], "phrase string, weight double"))
    table = symbols.symbol_table(symbols.extract_symbols(code).unionByName(mentions).unionByName(phrase))
    by_key = {r.key: r for r in table.collect()}
    assert (by_key["aclnnfoo"].name, by_key["aclnnfoo"].versions) == ("aclnnFOO", ["v1", "v2"])  # the first version has the name
    assert by_key["glm-5.1"].versions == ["kb"]
    texts = spark.createDataFrame([(1, "in enable_part12 and xnpumoey"), (2, "DispatchFFNCombine on glm-5.1; Vector core Timeout"), (3, None), (4, "nothing")], "id int, text string")
    hits = {}
    for r in sorted(symbols.match_symbols(texts, table).collect(), key=lambda r: (r.id, r.place)):
        hits.setdefault(r.id, []).append((r.name, r.kind, round(r.weight, 2)))
    assert hits == {1: [("enable_part1", "feature", 1.8), ("npumoe", "kernel", 3.0)], 2: [("vector core timeout", "phrase", 1.1), ("dispatchffncombine", "kernel", 2.25), ("glm-5.1", "model", 1.0)]}
    sig = {r.id: [(s.kind, s.text) for s in r.symbols] for r in signatures.symbol_signatures(symbols.match_symbols(texts, table)).collect()}
    assert sig[2] == [("op", "vector core timeout"), ("kernel", "dispatchffncombine"), ("model", "glm-5.1")]
    words = spark.createDataFrame([("Vector Core", 3.0), ("core", 9.0), ("GLM", 99.0), ("time", 1.0), ("Core", 5.0)], "word string, score double")
    learned = spark.createDataFrame([("on", 1.0)], "phrase string, weight double")
    signals = symbols.match_signal_words(texts, words, learned).where("id = 2").orderBy("place").collect()
    assert [(r.word, r.score) for r in signals] == [("Vector Core", 3.0), ("core", 9.0), ("time", 1.0), ("on", 1.0)]
    bodies = spark.createDataFrame([(1, "ERROR: weird thing failed\n" * 3), (2, "ERROR: vector core timeout\n" * 4)], "id int, text string")
    assert symbols.learned_delta(bodies, table).first().n == symbols.learned_phrases(bodies).join(table.select(F.col("key").alias("phrase")), "phrase", "left_anti").count() > 0


def test_signature_report(spark):
    docs = spark.createDataFrame([("d1", "s1", "Vector Core dies", "a"), ("d2", "s2", "vector core", "b"), ("d3", "s3", "memory again", "a")], "doc_id string, source_id string, title string, component string")
    chunks = spark.createDataFrame([("d1#0", "d1", "out of memory here"), ("d3#0", "d3", "it is out of memory")], "chunk_id string, doc_id string, text string")
    reports = spark.createDataFrame([("q", "RuntimeError: out of memory on Vector Core")], "query_id string, text string")
    words = spark.createDataFrame([("Vector Core", 3.0), ("memory", 2.0), ("on", 9.0)], "word string, score double")
    got = search.signature_report(chunks, docs, fulltext.postings(chunks), reports, words)
    assert [r.word for r in got["signal_words"].orderBy("place").collect()] == ["Vector Core", "memory"]
    assert [(r.doc_id, r.signal) for r in got["title_hits"].orderBy("place").collect()] == [("d2", "Vector Core"), ("d1", "Vector Core"), ("d3", "memory")]
    assert {r.doc_id for r in got["results"].collect()} == {"d1", "d3"}
    one = search.signature_report(chunks, docs, fulltext.postings(chunks), reports, words, component="a")
    assert {r.doc_id for r in one["title_hits"].collect()} == {"d1", "d3"}


def test_parsers(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    q = lambda t: tuple(one(parsing.component_query(F.lit(t)))[0])
    assert q("a-b:0.18.0 GLM hangs\nhere") == ("a-b", "0.18.0", "GLM hangs\nhere") and q(" plain words ") == (None, None, "plain words") and q("a:1") == (None, None, "a:1")
    aliases = {"own": "o/r"}
    refs = [one(parsing.document_reference(F.lit(t), "issue", aliases))[0] for t in ("own#12", "x/y#3", "github:o-r:pr:1", "word")]
    assert refs == ["github:o-r:issue:12", "github:x-y:issue:3", "github:o-r:pr:1", "word"]
    assert one(parsing.repository(F.lit("own"), aliases), parsing.repository(F.lit(None).cast("string"), aliases, "d/d"), parsing.repository(F.lit("z"), aliases)) == ("o/r", "d/d", "z")
    assert [one(parsing.body_version(F.lit(t), "engine"))[0] for t in ("**Engine version**: 0.26.0 engine 0.1.1", "- engine: v0.24.0", "engine 0.1", "engine/engine-x:v0.26.0", None)] == ["0.26.0", "0.24.0", None, None, None]
    rules = [(("own-fork",), "fork"), (("own",), "own")]
    assert [one(parsing.default_component(F.lit(t), rules))[0] for t in ("x/own-fork", "x/OWN", "a/b", "", None)] == ["fork", "own", "a-b", "doc", "doc"]
    assert [one(parsing.moving_category(F.lit(t)))[0] for t in ("nightly-x", "releases-1", "latest-a3", "main", "x-dev", "v1")] == ["nightly", "branch", "trunk", "trunk", "dev", "other"]
    assert one(parsing.time_text(F.lit("2024-01-01").cast("timestamp")), parsing.time_text(F.lit(None).cast("timestamp"))) == ("2024-01-01 00:00:00", "")
    s = F.struct(F.lit("op").alias("kind"), F.lit("x").alias("text"), F.lit(2.0).alias("weight"), F.lit("o").alias("origin"))
    assert one(parsing.signature_line(s))[0] == "[op] x (weight 2.0, from o)"
    assert one(parsing.parse_time(F.lit("never")))[0] is None


def test_companion_rows(spark):
    tags = spark.createDataFrame([("v0.9.1", "v0.9.1-a3"), ("v0.9.1", "v0.9.1"), ("v0.8.0rc1", "v0.8.0rc1"), ("glm5", "glm5")], "base string, tag string")
    images = spark.createDataFrame([("v0.9.1", ["X=/usr/CANN-8.1.2.rc1/lib", "SOC_VERSION=dev 9", "VER=python3.9", "PATH=/opt/python3.11/bin"])], "tag string, env array<string>")
    notes = spark.createDataFrame([("v0.9.1", "engine 9.9.9 is old; we align the plugin with upstream Engine at v0.9.0")], "base string, body string")
    got = {r.own: tuple(r) for r in companion.rows_of_tags(tags, images, notes, "own", "engine").collect()}
    assert got["v0.9.1"] == ("v0.9.1", "0.9.0", "8.1.2", "SOC=dev 9; python=3.11", "auto(cann=image+engine=upstream)")
    assert got["v0.8.0rc1"] == ("v0.8.0rc1", "0.8.0", "", "", "auto(engine=tag)") and got["glm5"] == ("glm5", "", "", "", "manual")
    cells = companion.unpivoted(spark.createDataFrame([(1, "0.9.1", "0.9.0"), (2, "0.8.0", "0.8.0")], "row_id int, own string, engine string"), ("own", "engine"))
    ask = spark.createDataFrame([("x", "own", "v0.9.1"), ("y", "own", "0.8.1")], "query_id string, component string, version string")
    assert {(r.query_id, r.row_id, r.place) for r in companion.resolved(ask, cells, 1).collect()} == {("x", 1, 1), ("y", 2, 1)}


def test_review_rows(spark):
    docs = spark.createDataFrame([("a", "github_issue", "[待审核] t", "unverified", 1), ("b", "doc", "u", "expert", None), ("c", "doc", None, "unverified", 3)], "source_id string, source_type string, title string, verification string, n int")
    gone = docs.where("source_id <> 'b'").select("source_id")
    backup = review.backed_up(docs, gone)
    left = docs.join(gone, "source_id", "left_anti")
    assert sorted(map(tuple, review.restored(left, backup).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str) and review.restored(docs, backup).count() == 3
    chunks = spark.createDataFrame([("a#0", "a"), ("b#0", "b")], "chunk_id string, doc_id string")
    parts = review.deleted_everywhere(docs.withColumnRenamed("source_id", "doc_id"), chunks, chunks.select("chunk_id"), gone.withColumnRenamed("source_id", "doc_id"))
    assert [p.count() for p in parts] == [1, 1, 1] and [r.chunk_id for r in review.deleted_chunks(chunks, gone.withColumnRenamed("source_id", "doc_id"))[1].collect()] == ["a#0"]
    assert [r.source_id for r in review.external_documents(docs).collect()] == ["b", "c"] and [r.source_id for r in review.external_documents(docs, 1, 1).collect()] == ["c"]
    assert {r.item_ref for r in review.unverified(docs).collect()} == {"a", "c"} and {r.item_ref for r in review.marked_titles(docs).collect()} == {"a"}
    items = spark.createDataFrame([("i", "symbol", "pending"), ("j", "companion", "deleted")], "item string, category string, status string")
    assert review.queue(items, "symbol", "pending").count() == 1 and review.queue(items, status="deleted").first()["item"] == "j"
    for bad in ({"category": "x"}, {"status": "x"}):
        with pytest.raises(ValueError):
            review.queue(items, **bad)
    with pytest.raises(Exception, match="no such category"):
        review.checked(items.withColumn("category", F.lit("x")), review.CATEGORIES).collect()
    assert review.item(items, "i").count() == 1 and [r["item"] for r in review.without_item(items, "i").collect()] == ["j"]


def test_manual_chunks(spark):
    text = "1 First\nalpha\n\nbeta\n1.1 Second\n" + "x" * 50 + "\n2 Third\n3 Fourth\nend"
    got = [tuple(r) for r in chunking.chunk_manuals(spark.createDataFrame([("m", text), ("n", None), ("o", "plain text")], "source_id string, body string"), most=30, overlap=0).orderBy("chunk_id").collect()]
    assert [(c, s) for c, _, _, s, _ in got] == [("m#0", "1 First"), ("m#1", "1.1 Second"), ("m#2", "1.1 Second"), ("m#3", "3 Fourth"), ("o#0", "")]
    assert got[0][4] == "【1 First】\nalpha\n\nbeta" and got[1][4] == "【1.1 Second】\n" + "x" * 30 and got[4][4] == "plain text"


WRITES = {"write", "save", "saveAsTable", "insertInto", "parquet", "createOrReplaceTempView", "createTempView", "mode", "rewrite"}


def test_query_functions_only_read():
    """Entry points of searches, traversals and look-ups hold no call that writes; what they store goes through ``stored`` alone."""
    for path in ("lodestone/plans/search.py", "lodestone/operators/hybrid.py", "lodestone/operators/fulltext.py", "lodestone/operators/companion.py", "lodestone/operators/code.py", "lodestone/operators/asof.py", "lodestone/operators/vectors.py"):
        with open(path) as f:
            called = {n.func.attr for n in ast.walk(ast.parse(f.read())) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)} | {n.attr for n in ast.walk(ast.parse(open(path).read())) if isinstance(n, ast.Attribute) and n.attr in ("write", "writeStream", "writeTo")}
        assert not called & WRITES, path


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from lodestone.operators import stored

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        stored.shared_folder(Session)
    assert search_tokens is not None and spark is not None
