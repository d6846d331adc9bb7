"""Builds: one version of all tables, increments, undo, embedding once; and the stores and sources that feed them."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import symbols
from lodestone.functions.text import search_tokens
from lodestone.operators import fulltext, graph, patterns
from lodestone.operators.segments import FAN, Conflict, Segments
from lodestone.operators.vector_store import VectorStore
from lodestone.plans import build
from lodestone.sources import registry, sinks

WORDS = "memory timeout trap error engine graph kernel page cache token fails again when loading large model".split()


def documents(spark, rows):
    """(source_id, body, status) as canonical documents."""
    return spark.createDataFrame([(i, f"title {i}", b, s, "2024-01-01") for i, b, s in rows], "source_id string, title string, body string, status string, created_at string")


def whole(built):
    """All that a version holds, by table."""
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    return {
        "docs": rows(built.docs, "source_id", "body", "status"), "chunks": rows(built.chunks, "chunk_id", "doc_id", "text"), "index": rows(built.index, "token", "chunk_id", "pos"),
        "lengths": rows(built.lengths, "chunk_id", "dl"), "vectors": sorted((r.chunk_id, r.doc_id, tuple(round(x, 6) for x in r.embedding)) for r in built.vectors.read().collect()),
    }


def some_rows(r, n):
    return [(f"d{i}", " ".join(r.choices(WORDS, k=r.randint(0, 12))), r.choice(["open", "closed"])) for i in range(n)]


def test_increments_equal_a_full_build(spark, tmp_path):
    """Random edits over several builds: tables and ranks are those of one build from nothing."""
    r = random.Random(6)
    rows = some_rows(r, 12)
    path = str(tmp_path / "kb")
    build.ingest_documents(spark, documents(spark, rows), path)
    for _ in range(2):
        some = {i: (i, " ".join(r.choices(WORDS, k=r.randint(0, 8))) if r.random() < 0.7 else b, r.choice(["open", "closed"])) for i, b, s in r.sample(rows, 4)} | {f"n{r.random()}": (f"n{len(rows)}", "a new page", "open")}
        rows = [some.get(x[0], x) for x in rows] + [v for k, v in some.items() if k.startswith("n")]
        last = build.ingest_documents(spark, documents(spark, list(some.values())), path)
    full = build.ingest_documents(spark, documents(spark, rows), str(tmp_path / "full"))
    assert whole(last) == whole(full) and last.version == 2
    queries = spark.createDataFrame([("q", "memory"), ("p", "page cache"), ("n", "new page")], "query_id string, text string").select("query_id", search_tokens(F.col("text")).alias("tokens"))
    ranks = lambda b: sorted((x.query_id, x.chunk_id, x.place, round(x["rank"], 9)) for x in fulltext.search(b.index, b.lengths, queries).collect())
    assert ranks(last) == ranks(full)
    back = build.undo(spark, path, 0)
    assert whole(back) == whole(build.opened(spark, path, version=0)) != whole(last) and back.version == 3
    assert whole(build.opened(spark, path, version=2)) == whole(full)
    build.tables(spark, path).vacuum()
    assert whole(build.opened(spark, path)) == whole(back)
    with pytest.raises(FileNotFoundError):
        build.opened(spark, path, version=2)


@pytest.mark.parametrize("step", ["docs", "chunks", "postings", "lengths", "vectors", "gone", "commit"])
def test_a_build_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "kb")
    before = whole(build.ingest_documents(spark, documents(spark, [("a", "memory error", "open"), ("b", "page", "open")]), path))
    write, needed, commit = Segments._write, Segments._needed, Segments._commit

    def fail(self, table, *rest):
        if table == step:
            raise OSError("no space")
        return write(self, table, *rest)

    def broken(*_):
        raise OSError("no space")

    monkeypatch.setattr(Segments, "_write", fail)
    monkeypatch.setattr(Segments, "_needed", broken if step == "gone" else needed)
    monkeypatch.setattr(Segments, "_commit", broken if step == "commit" else commit)
    changed = documents(spark, [("a", "timeout", "closed"), ("c", "graph", "open")])
    for rebuild in (False, True):
        if step == "gone" and rebuild:
            continue  # nothing is named as gone by a rebuild
        with pytest.raises(OSError):
            build.ingest_documents(spark, changed, path, rebuild=rebuild)
        assert whole(build.opened(spark, path)) == before
    monkeypatch.undo()
    after = build.ingest_documents(spark, changed, path)
    assert {x[0] for x in whole(after)["docs"]} == {"a", "b", "c"} and {r.source_id: r.action for r in after.actions.collect()} == {"a": "embed", "c": "embed"}


def test_builds_that_meet(spark, tmp_path):
    """Of two builds from one version the second to commit is refused."""
    path = str(tmp_path / "kb")
    build.ingest_documents(spark, documents(spark, [("a", "memory", "open")]), path)
    store = build.tables(spark, path)
    state = store.state()
    build.ingest_documents(spark, documents(spark, [("b", "page", "open")]), path)
    with pytest.raises(Conflict):
        store.commit(state, {}, {})
    assert build.opened(spark, path).docs.count() == 2


def size(path):
    return sum(os.path.getsize(p) for p in glob.glob(f"{path}/data/**/*.parquet", recursive=True))


def test_a_document_writes_in_proportion(spark, tmp_path):
    """One document more writes as much whether hundreds are there or ten times as many."""
    wrote = []
    for n in (30, 300):
        path = str(tmp_path / f"kb{n}")
        build.ingest_documents(spark, documents(spark, [(f"d{i}", f"page {i} " + " ".join(WORDS) * 20, "open") for i in range(n)]), path)
        before = size(path)
        build.ingest_documents(spark, documents(spark, [("d1", "memory", "open"), ("d2", "page 2 " + " ".join(WORDS) * 20, "closed")]), path)
        wrote.append(size(path) - before)
        assert wrote[-1] < before / 2 or n == 30
    assert wrote[1] < 1.5 * wrote[0]


def test_segments_are_merged(spark, tmp_path):
    """Many small commits leave few segments, and the rows of the last word on each key."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    store = Segments(spark, str(tmp_path / "s"), {"t": (schema, "k", "g"), "u": (schema, "k", "h")})
    want, r = {}, random.Random(1)
    for i in range(2 * FAN + 3):
        state = store.state()
        keys = r.sample("abcdef", 2)
        rows = spark.createDataFrame([(k, i) for k in keys if k != "f"], "k string, v int")
        store.commit(state, {"t": store.written("t", rows, state)}, {"g": spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")})
        for k in keys:
            want.pop(k, None)
            if k != "f":
                want[k] = i
        assert {x.k: x.v for x in store.read("t").collect()} == want and store.read("u").count() == 0
    assert len(store.state()["segments"]["t"]) < FAN and len(store.state()["gone"]["g"]) < FAN


class Provider:
    """Vectors of texts; each text that it is asked for is put down in a file."""

    __qualname__ = "Provider"

    def __init__(self, path):
        self.path = path

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]


def test_a_text_is_embedded_once(spark, tmp_path, monkeypatch):
    """Over repeats in a build, builds, rebuilds and a build that failed."""
    provider, path = Provider(str(tmp_path / "asked")), str(tmp_path / "kb")
    rows = [(f"d{i}", f"text {i % 7} " + "w " * (i % 3), "open") for i in range(40)]
    commit = Segments._commit
    monkeypatch.setattr(Segments, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        build.ingest_documents(spark, documents(spark, rows[:20]), path, provider=provider)
    monkeypatch.setattr(Segments, "_commit", commit)
    for some, rebuild in ((rows[:20], False), (rows, False), (rows, True), (rows + [("new", "another", "open")], False)):
        built = build.ingest_documents(spark, documents(spark, some), path, rebuild=rebuild, provider=provider)
    texts = [json.loads(x) for x in open(provider.path)]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in built.chunks.collect()}
    assert {(r.chunk_id, r.embedding[0]) for r in built.vectors.read().collect()} == {(r.chunk_id, float(len(r.text))) for r in built.chunks.collect()}


def test_the_source_named_first_counts(spark, tmp_path):
    """Of one id in two sources, whenever each was created; and inside a source its own order."""
    class Listed:
        def __init__(self, rows, order=True):
            self.rows, self.order = rows, order

        def canonicalize(self, spark):
            df = spark.createDataFrame(self.rows, "source_id string, body string, created_at string, ingest_order int")
            return df if self.order else df.drop("ingest_order")

    sources = [Listed([("x", "late", "2025", 2), ("x", "first", "2026", 1), ("y", "only", "2024", 3)]), Listed([("x", "other", "2020", 0), ("z", "older", "2020", 0), ("z", "newer", "2021", 0)], False)]
    docs = sinks.unique(registry.collect(spark, sources))
    assert {r.source_id: r.body for r in docs.collect()} == {"x": "first", "y": "only", "z": "older"} and "ingest_order" not in docs.columns
    built = build.ingest_documents(spark, registry.collect(spark, sources), str(tmp_path / "kb"))
    assert built.docs.where("source_id = 'x'").first().body == "first"


def test_chunks_that_move_and_repeated_documents(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), buckets=4)
    rows = lambda *r: spark.createDataFrame([(c, d, [float(x)], {"k": "v"}) for c, d, x in r], "chunk_id string, doc_id string, embedding array<float>, meta map<string,string>")
    held = lambda: sorted((r.chunk_id, r.doc_id, r.embedding[0], r.meta["k"]) for r in store.read().collect())
    store.add(rows(("c1", "a", 1), ("c2", "a", 2), ("c3", "b", 3)))
    store.add(rows(("c1", "z", 9)))
    assert held() == [("c1", "z", 9.0, "v"), ("c2", "a", 2.0, "v"), ("c3", "b", 3.0, "v")]
    store.update_meta(spark.createDataFrame([("a", {"k": "n"}), ("a", {"k": "m"}), ("b", None)], "doc_id string, meta map<string,string>"))
    assert held() == [("c1", "z", 9.0, "v"), ("c2", "a", 2.0, "n"), ("c3", "b", 3.0, "v")]
    store.replace(spark.createDataFrame([("b",)], "doc_id string"), rows(("c2", "b", 5), ("c2", "b", 5)))
    assert held() == [("c1", "z", 9.0, "v"), ("c2", "b", 5.0, "v")]


def test_only_queries_over_the_graph(spark):
    tables = {"node_issue": spark.createDataFrame([("i", "t")], "id string, title string")}
    spark.createDataFrame([("x",)], "id string").createOrReplaceTempView("victim")
    for sql in ("INSERT INTO victim SELECT id FROM node_issue", "WITH t AS (SELECT id FROM node_issue) INSERT INTO victim SELECT * FROM t", "CREATE TABLE t AS SELECT 1", "WITH t AS (SELECT 1) FROM t INSERT INTO victim SELECT *", "SELECT", "SET a = 1", "EXPLAIN SELECT 1", "SELECT reflect('java.lang.Math', 'abs', 1)", "MERGE INTO victim USING node_issue ON true WHEN MATCHED THEN DELETE"):
        with pytest.raises(ValueError):
            graph.query(spark, tables, sql)
    for sql in ("SELECT id FROM node_issue", "WITH t AS (SELECT id FROM node_issue) SELECT * FROM t", "FROM node_issue SELECT id", "(SELECT id FROM node_issue) UNION ALL SELECT 'i' LIMIT 1"):
        assert [r.id for r in graph.query(spark, tables, sql).collect()] == ["i"]


def test_equal_images_under_any_name(spark, tmp_path):
    for folder, name, data in (("x", "a.png", b"1"), ("x", "b.png", b"1"), ("y", "a.png", b"2"), ("y", "c.png", b"3")):
        (tmp_path / "img" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / folder / name).write_bytes(data)
    read = [{"path": "x/b.png", "text": "RuntimeError: out of memory retCode=507014"}, {"path": "./y/a.png", "text": "retCode=507015"}, {"path": "c.png", "text": "retCode=507016"}]
    (tmp_path / "read.json").write_text("\n".join(map(json.dumps, read)))
    got = registry.build_sources([{"type": "images", "path": str(tmp_path / "img"), "results": str(tmp_path / "read.json")}])[0].canonicalize(spark).collect()
    assert len(got) == 3 and sorted(n for n in ("507014", "507015", "507016") if any(n in r.body for r in got)) == ["507014", "507015", "507016"]


def test_patterns_of_any_script(spark):
    """As plain containment says, over random texts, whatever the number of parts."""
    r = random.Random(9)
    letters = "abAB_ é内存不足錯误😀\U00020000ßİ\n'\\"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    keys = [word(r.randint(0, 4)) for _ in range(60)] + [None, "", "内存不足错误"]
    texts = [(i, word(r.randint(0, 40))) for i in range(80)] + [(1000, None), (1001, "出现内存不足错误了"), (None, "ab")]
    want = {(i, k) for i, t in texts for k in keys if t and k and k in t}
    for part in (1 << 20, 200):
        got = patterns.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(k,) for k in keys], "key string"), part_bytes=part).collect()
        assert {tuple(x) for x in got} == want
    none = spark.createDataFrame([], "key string")
    assert patterns.contained(spark.createDataFrame(texts, "id long, text string"), none).count() == 0


def test_signal_words_of_any_script(spark):
    words = spark.createDataFrame([("内存不足错误", 5.0), ("内存", 4.0), ("Vector Core", 3.0), ("ÉCHEC", 2.0)], "word string, score double")
    texts = spark.createDataFrame([(1, "报错: 内存不足错误, VECTOR CORE"), (2, "un échec"), (3, None)], "id long, text string")
    assert sorted((x.id, x.word, x.place) for x in symbols.match_signal_words(texts, words).collect()) == [(1, "Vector Core", 1), (1, "内存不足错误", 2), (2, "ÉCHEC", 1)]


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            out += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_rare_phrase_reads_few_rows(spark, tmp_path, monkeypatch):
    """However many documents there are; and the answers are those of the whole index."""
    monkeypatch.setattr(build, "POSTING_ROWS", 100)
    r, read = random.Random(2), []
    for n in (200, 2000):
        rows = [(f"d{i}", " ".join(r.choices(WORDS, k=30)) + (" rare thing here" if i in (3, 70) else ""), "open") for i in range(n)]
        built = build.ingest_documents(spark, documents(spark, rows), str(tmp_path / f"kb{n}"))
        some = fulltext.narrowed(built.index, ["rare", "thing"])
        assert some.count() == 4
        held = fulltext.narrowed(built.index, ["rare", "thing"])
        held.collect()
        read.append(scanned(held))
        queries = spark.createDataFrame([("q", ["rare", "thing"]), ("p", ["memory", "timeout"])], "query_id string, tokens array<string>")
        places = lambda df, **o: sorted(map(tuple, fulltext.phrase_places(df, queries, **o).collect()))
        narrow, prefixed = places(built.index), places(built.index, prefix=True)
        monkeypatch.setattr(fulltext, "PUSHED", 0)
        assert places(built.index) == narrow and places(built.index, prefix=True) == prefixed and ("q", "d70#0", 1) in narrow
        monkeypatch.setattr(fulltext, "PUSHED", 64)
    assert read[1] < 2 * read[0] and read[1] < 0.05 * built.index.count()


def test_a_graph_follows_its_documents(spark, tmp_path):
    """After random edits and removals the tables are those of a graph built anew; only what changed is extracted."""
    r = random.Random(12)
    shape = "source_id string, source_type string, repo string, number long, title string, body string, status string, created_at string, resolved_at string, merged_at string, url string"

    def made(i):
        kind = ("issue", "pr", "doc")[i % 3]
        body = r.choice(["", f"Fixes #{3 * r.randrange(4)}", f"fixed by #{3 * r.randrange(4) + 1}", "Fixes #6", "retCode=507014 in npuScatter", "命令格式\nnpu-tool -get"])
        return (f"github:o-r:{kind}:{i}" if kind != "doc" else f"doc:{i}", {"issue": "github_issue", "pr": "github_pr", "doc": "doc_pdf"}[kind], "o/r", i, f"title {r.randrange(3)}", body, "closed", "2024-01-01", None, "2024-01-15T00:00:00Z" if kind == "pr" and r.random() < 0.7 else None, None)

    frame = lambda rows: spark.createDataFrame(rows, shape)
    said = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"\d{6}"), F.lit(0)), lambda x: F.struct(F.lit("error_code").alias("kind"), x.alias("name")))
    calendar = spark.createDataFrame([("o/r", "v1", "2024-02-01", "release")], "repo string, tag string, date string, kind string").withColumn("date", F.col("date").cast("timestamp"))
    rows = lambda tables: {n: sorted(map(str, t.collect())) for n, t in tables.items()}
    held = {i: made(i) for i in range(12)}
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    store.update(frame(list(held.values())), said)
    first = rows(store.read(calendar))
    assert first == rows(graph.relations(frame(list(held.values())), calendar, said)) and first["edge_fixes"]
    for _ in range(2):
        some, out = r.sample(sorted(held), 4), held.pop(r.choice(sorted(held)))
        held |= {i: made(i) for i in some if i in held}
        store.update(frame([held[i] for i in some if i in held]), said, removed=frame([out]).select("source_id"))
        assert rows(store.read(calendar)) == rows(graph.relations(frame(list(held.values())), calendar, said))
    assert rows(store.read(calendar, 0)) == first


def test_a_table_may_gain_columns(spark, tmp_path):
    """Older segments stay as they are; their rows have nulls, after a merge as well."""
    field = lambda n: T.StructField(n, T.StringType())
    old = Segments(spark, str(tmp_path / "s"), {"t": (T.StructType([field("k"), field("v")]), "k", "g")})
    state = old.state()
    old.commit(state, {"t": old.written("t", spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), state)}, {})
    new = Segments(spark, str(tmp_path / "s"), {"t": (T.StructType([field("k"), field("more"), field("v")]), "k", "g")})
    for i in range(FAN):
        state = new.state()
        rows = spark.createDataFrame([("b", f"m{i}", "3")], "k string, more string, v string")
        new.commit(state, {"t": new.written("t", rows, state)}, {"g": rows.select("k")})
        assert {tuple(r) for r in new.read("t").collect()} == {("a", None, "1"), ("b", f"m{i}", "3")}


def test_segments_that_are_mostly_gone(spark, tmp_path):
    """A commit leaves out what is gone of segments that are gone by half; others are read by a join, and older versions stay."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    store = Segments(spark, str(tmp_path / "s"), {"t": (schema, "k", "g"), "u": (schema, "k", "g")}, thin=True)
    frame = lambda keys, v: spark.createDataFrame([(k, v) for k in keys], schema)
    got = lambda name, version=None: sorted((r.k or "", r.v) for r in store.read(name, store.state(version)).collect())

    def put(t, u, v):
        state = store.state()
        gone = {"g": frame([*t, *t, *u], v).select("k")} if state["version"] >= 0 else {}
        store.commit(state, {"t": store.written("t", frame(t, v), state), "u": store.written("u", frame(u, v), state)}, gone)

    paths = lambda name: [s["path"] for s in store.state()["segments"][name]]
    put("abcd", [*"aaaaaaab", None], 0)
    first = {n: paths(n) for n in "tu"}
    put("b", "x", 1)  # a quarter of one table, an eighth of the other
    assert {n: paths(n)[:1] for n in "tu"} == first and got("t") == [("a", 0), ("b", 1), ("c", 0), ("d", 0)]
    assert "gone_key" in store.read("t")._jdf.queryExecution().toString()
    put("bcd", "", 2)  # the second one's segments stay but for one key
    assert first["t"][0] not in paths("t") and got("t") == [("a", 0), ("b", 2), ("c", 2), ("d", 2)]
    assert paths("u")[0] == first["u"][0] and got("u") == [("", 0)] + [("a", 0)] * 7 + [("x", 1)]
    put("abcdefgh", "ax", 3)  # all of one table, and of the other all but the row without a key
    assert len(paths("t")) == 1 and got("u") == [("", 0), ("a", 3), ("x", 3)] and store.state()["gone"]["g"] == [] and "gone_key" not in store.read("t")._jdf.queryExecution().toString()
    assert got("t") == [(k, 3) for k in "abcdefgh"] and got("t", 1) == [("a", 0), ("b", 1), ("c", 0), ("d", 0)]
