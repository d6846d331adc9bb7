import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import confidence, references, signatures, symbols
from lodestone.functions.text import fold, search_tokens, strip
from lodestone.functions.versions import version, version_distance, version_kind
from lodestone.operators import asof, canonical, chunking, companion, fulltext, hybrid, ingest, review


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    r = one(spark, strip(F.lit("　 a b \n")), fold(F.lit("Éàß")), search_tokens(F.lit("a_b Ñandú 3.5")), search_tokens(F.lit(None).cast("string")))
    assert list(r) == ["a b", "eaß", ["a", "b", "nandu", "3", "5"], []]


def test_versions(spark):
    v = lambda s: version(F.lit(s))
    r = one(spark, v("v0.6.4.post1"), v("x"), version_distance(v("0.6.4"), v("1.5.1")), version_kind(F.lit("v1.0rc1")), version_kind(F.lit("v1.dev3")), version_kind(F.lit("v1.0")))
    assert tuple(r[0]) == (0, 6, 4) and r[1] is None and abs(r[2] - 11.3) < 1e-9 and list(r)[3:] == ["rc", "pre", "release"]


def test_weights(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    r = one(
        spark, confidence.time_weight(t("2025-01-01"), none, t("2026-01-01")), confidence.time_weight(none, none, t("2026-01-01")), confidence.time_weight(t("2027-01-01"), none, t("2026-01-01")),
        confidence.version_weight(version(F.lit("0.5")), version(F.lit("0.6")), version(F.lit("0.5.9"))), confidence.version_weight(version(F.lit(None).cast("string")), version(F.lit(None).cast("string")), version(F.lit("1.0"))),
        confidence.reliability(F.lit("github_issue"), F.lit("closed"), t("2025-01-01"), F.lit("doc"), F.lit("")), confidence.reliability(F.lit("github_issue"), F.lit("open"), none, F.lit("bug"), F.lit("expert")), confidence.final_score(F.lit(0.0), F.lit(0.0)),
    )
    assert [round(x, 6) for x in r] == [0.575, 1.0, 1.0, 1.0, 0.5, 0.36, 0.95, 0.0]


def chunks_by_hand(text, most, overlap):
    text = text.strip()
    if not text:
        return []
    if len(text) <= most:
        return [text]
    import re

    raw, cur, n = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        while len(p) > most:
            raw, cur, n, p = [*raw, *(["\n".join(cur)] if cur else []), p[:most]], [], 0, p[most:]
        if not p:
            continue
        if cur and n + len(p) + 2 > most:
            raw, cur, n = [*raw, "\n".join(cur)], [], 0
        cur, n = [*cur, p], n + len(p) + 2
    raw += ["\n".join(cur)] if cur else []
    return [c if not i or not overlap else raw[i - 1][-overlap:] + "\n" + c for i, c in enumerate(raw)]


@pytest.mark.parametrize("overlap", [0, 3])
def test_chunks(spark, overlap):
    texts = ["", "short", "aaaa\n\nbbbb\n \ncccc dddd", "x" * 25, "x" * 20, "ab\n\n" + "y" * 23 + "\n\nzz\n\nq", "p\n\n" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "source_id int, body string")
    got = {}
    for r in chunking.chunk_documents(docs, 10, overlap).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert [got.get(i, []) for i in range(len(texts))] == [chunks_by_hand(t, 10, overlap) for t in texts]


def test_sections(spark):
    text = "intro\n1 First\n1.1 Second\nbody one\n2 Third\nbody two"
    docs = spark.createDataFrame([("m", text)], "source_id string, body string")
    rows = chunking.chunk_manuals(docs, 100, 0).orderBy("seq").collect()
    assert [(r.section, r.text) for r in rows] == [("", "intro"), ("1.1 Second", "【1.1 Second】\nbody one"), ("2 Third", "【2 Third】\nbody two")]


def test_phrases_and_fallback(spark):
    chunks = spark.createDataFrame([("c1", "alpha beta alpha beta"), ("c2", "beta alpha"), ("c3", "alphabet soup"), ("c4", "")], "chunk_id string, text string")
    index, lengths = fulltext.postings(chunks), fulltext.token_lengths(chunks)
    ask = spark.createDataFrame([("p", ["alpha", "beta"]), ("f", ["alph", "zzz"]), ("n", ["qqq"])], "query_id string, tokens array<string>")
    tf = {(r.query_id, r.chunk_id): r.tf for r in fulltext.phrase_places(index, ask).collect()}
    assert tf == {("p", "c1"): 2}
    found = {(r.query_id, r.chunk_id) for r in fulltext.search(index, lengths, ask).collect()}
    assert found == {("p", "c1"), ("f", "c1"), ("f", "c2"), ("f", "c3")}


def test_merge_and_order(spark):
    v = spark.createDataFrame([("a", 0.9, 1), ("b", 0.4, 2)], "chunk_id string, sim double, place int")
    f = spark.createDataFrame([("b", 0.5, 1), ("c", 0.3, 2)], "chunk_id string, sim double, place int")
    got = {r.chunk_id: (r.sim, r.src) for r in hybrid.merged(v, f).collect()}
    assert got == {"a": (0.9, "vector"), "b": (0.5, "both"), "c": (0.3, "fts")}
    rows = spark.createDataFrame([("q", "c1", "d1", 0.4, 0.9, True), ("q", "c2", "d2", 0.4, 0.1, False), ("q", "c3", "d2", 0.4, 0.05, False), ("r", "c1", "d1", 0.6, 0.9, True), ("r", "c2", "d2", 0.4, 0.1, False)], "query_id string, chunk_id string, doc_id string, sim double, final double, resolved boolean")
    rows = rows.withColumns({"v_place": F.lit(1), "f_place": F.lit(None).cast("int")})
    got = {(r.query_id, r.place): r.chunk_id for r in hybrid.ordered(rows, "query_id").collect()}
    assert got == {("q", 1): "c2", ("q", 2): "c1", ("r", 1): "c1", ("r", 2): "c2"}


@pytest.mark.parametrize("more", [0, 3000])
def test_asof(spark, more):
    """Null keys, tags and dates, and calendars of any size, which give the same."""
    cal = spark.createDataFrame([("r", "v1", "2026-01-01 10:00:30"), ("r", "v2", "2026-02-01 00:00:00"), ("s", "w1", "2026-01-01 00:00:00"), (None, "n1", "2026-01-01 00:00:00"), ("r", None, "2026-01-15 00:00:00"), ("r", "v9", None)], "repo string, tag string, date string").withColumn("date", F.col("date").cast("timestamp"))
    cal = cal.union(spark.range(more).select(F.lit("other"), F.concat(F.lit("o"), F.col("id").cast("string")), F.timestamp_seconds(F.col("id") * 100_000)))
    rows = spark.createDataFrame([(1, "r", "2026-01-01 10:00:45"), (2, "r", "2025-01-01 00:00:00"), (3, "r", "2026-03-01 00:00:00"), (4, "s", "2026-01-01 00:00:00"), (5, "t", "2026-01-01 00:00:00"), (6, "r", None), (7, None, "2026-01-01 00:00:00")], "id int, repo string, at string").withColumn("at", F.col("at").cast("timestamp"))
    back = {r.id: r.tag for r in asof.latest_before(rows, cal, "at", ["repo"]).collect()}
    ahead = {r.id: r.tag for r in asof.first_after(rows, cal, "at", ["repo"]).collect()}
    assert back == {1: "v1", 2: None, 3: "v2", 4: "w1", 5: None, 6: None, 7: None}
    assert ahead == {1: "v1", 2: "v1", 3: None, 4: "w1", 5: None, 6: None, 7: None}  # to the minute


def test_companion(spark):
    m = spark.createDataFrame([(1, "0.18.0", "0.12.1", "8.1"), (2, "0.17.0", "0.11.3", ""), (3, "0.16.0", "0.10.1", "8.0")], "row_id int, a string, b string, c string")
    cells = companion.unpivoted(m, ("a", "b", "c"))
    ask = spark.createDataFrame([("x", "a", "v0.18.0"), ("y", "a", "0.17.5"), ("z", "a", "none")], "query_id string, component string, version string")
    got = {(r.query_id, r.component): r.versions for r in companion.expand(ask, cells, 2).collect()}
    assert got == {("x", "b"): ["0.12.1"], ("x", "c"): ["8.1"], ("y", "b"): ["0.11.3", "0.12.1"], ("y", "c"): ["8.1"]}


def test_signatures(spark):
    text = 'kernel_name=OpA\nretCode=6\nFile "/x/torch/ops/run.py", line 3, in call_op\nValueError: out of memory'
    got = {(s.kind, s.text) for s in one(spark, signatures.extract_signatures(F.lit(text)))[0]}
    assert {("kernel", "opa"), ("errcode", "6"), ("stack_func", "call_op"), ("module", "torch/ops/run.py"), ("phrase", "valueerror"), ("phrase", "out of memory")} <= got
    assert one(spark, signatures.extract_signatures(F.lit(None).cast("string")))[0] == []


def test_signature_search_takes_every_twentieth(spark, sf_dir):
    from lodestone.catalogue import texts

    reports = texts._reports(spark, sf_dir)
    docs = reports.select("id", "title", search_tokens(F.col("text")).alias("w"), signatures.extract_signatures(F.col("text")).alias("s")).orderBy("id")
    found = docs.select("id", "title", "w", F.transform("s", lambda s: F.struct(s["kind"], s["text"], s["weight"], search_tokens(s["text"]))).alias("s")).collect()
    padded = {r.id: f" {' '.join(r.w)} " for r in found}
    want = set()
    for q in (r for r in found if r.id % 20 == 0):
        scores, held = {}, {}
        for _, text, weight, tokens in q.s:
            hits = [r for r in found if tokens and f" {' '.join(tokens)} " in padded[r.id]][:30]
            for r in hits:
                scores[r.id] = scores.get(r.id, 0) + weight * (1.5 if text in (r.title or "").lower() else 1)
                held.setdefault(r.id, set()).add(text)
        best = sorted(scores, key=lambda d: (-round(scores[d], 3), d))[:15]
        want |= {(q.id, d, round(scores[d], 3), tuple(sorted(held[d])), n + 1) for n, d in enumerate(best)}
    got = texts.signature_search_scores(spark, sf_dir).collect()
    assert {(r.query_id, r.doc_id, r.score, tuple(r.signatures), r.place) for r in got} == want and len(got) == len(want)
    assert {r.query_id for r in got} == {r.id for r in found if r.id % 20 == 0}


def test_hybrid_answers_every_item(spark, sf_dir):
    import math

    from lodestone.catalogue import retrieval

    words = {r.doc_id: r.w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", search_tokens(F.col("text")).alias("w")).collect()}
    mean = sum(map(len, words.values())) / len(words)
    docs = retrieval.derived_documents(spark, sf_dir).withColumn("sim", F.lit(1.0))
    weight = {r.doc_id: (r.final, r.resolved) for r in hybrid.weighted(docs, F.lit(retrieval.NOW).cast("timestamp"), F.lit("0.5.0")).collect()}

    def ranks(tf):
        idf = math.log((len(words) - len(tf) + 0.5) / (len(tf) + 0.5))
        return {d: (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[d]) / mean)) for d, n in tf.items()}

    def counts(hit):
        return {d: n for d, w in words.items() if (n := sum(hit(w, i) for i in range(len(w))))}

    want, fell_back = {}, set()
    for r in retrieval._one_word(spark, sf_dir).collect():
        rank = ranks(counts(lambda w, i, q=r.tokens: w[i : i + len(q)] == q))
        if not rank:
            fell_back.add(r.query_id)
            for t in r.tokens:
                for d, x in ranks(counts(lambda w, i, t=t: w[i].startswith(t))).items():
                    rank[d] = rank.get(d, 0) + x
        top = sorted(rank, key=lambda d: (-rank[d], d))[:50]
        sim = {d: min(0.5, rank[d] / (rank[d] + 3)) for d in top}
        late = max((round(sim[d], 4) for d in top if weight[d][1]), default=1) < 0.5
        final = {d: sim[d] ** 0.6 * weight[d][0] for d in top}
        best = sorted(top, key=lambda d: (late and weight[d][1], -final[d], top.index(d)))[:10]
        want |= {(r.query_id, d): final[d] for d in best}
    got = {(r.query_id, r.doc_id): r.final for r in retrieval.hybrid_topk_all_items(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert fell_back & {q for q, _ in got}


def test_references(spark):
    text = "Fixes #12, closes issue #7 and resolves own/other#9; fixed in #3"
    r = one(spark, references.fix_references(F.lit(text), F.lit("a/b")), references.fixed_by_references(F.lit("fixed by #5, fixed in #6"), F.lit("a/b")), references.source_id(F.lit("a/b"), "pr", F.lit(4)))
    assert [tuple(x) for x in r[0]] == [("a/b", 7), ("a/b", 12), ("own/other", 9)] and [tuple(x) for x in r[1]] == [("a/b", 5)] and r[2] == "github:a-b:pr:4"


def test_symbols(spark):
    names = ["DispatchFFNCombine", "dispatch_ffn_combine", "DispatchFFNCombineW4A8", "npuMulV2"]
    assert list(one(spark, *[symbols.normalised(F.lit(n)) for n in names])) == ["dispatch_ffn_combine", "dispatch_ffn_combine", "dispatch_ffn_combine", "npu_mul"]
    src = spark.createDataFrame([("1", "a.cpp", "int x;\nvoid Foo::run_it(int a,\n  int b) const {\n}\nstruct Node {}")], "version string, path string, content string")
    got = {(r.symbol, r.line) for r in symbols.code_symbols(src).collect()}
    assert got == {("run_it", 2), ("node", 5)}


def test_canonical(spark):
    body = "Engine 0.3.1 broke\n### Your current environment\npip"
    items = spark.createDataFrame([(1, "[Bug] x", body, ["l", "v0.4.x"], "closed", "c", "u", "z", None, False, None, None), (2, "t", None, [], "open", "c", "u", None, "http://u", True, True, "m")], "number long, title string, body string, labels array<string>, state string, created_at string, updated_at string, closed_at string, html_url string, is_pr boolean, merged boolean, merged_at string")
    notes = spark.createDataFrame([(1, 2, "b", "t2", "second"), (1, 1, None, "t1", "first")], "number long, position int, login string, created_at string, body string")
    a, b = canonical.canonical_documents(items, notes, "o/r", "engine", {"engine": (("engine",), r"0\.\d+\.\d+")}).orderBy("source_id").collect()
    assert a.body == "Engine 0.3.1 broke\n\n---\n\n### unknown (t1):\nfirst\n\n### b (t2):\nsecond" and (a.status, a.version_min, a.kind, a.environment) == ("closed", "0.4", "bug", "### Your current environment\npip")
    assert (b.source_id, b.status, b.resolved_at, b.version_min, b.body) == ("github:o-r:pr:2", "merged", "m", None, "")


def test_ingest_plan_backfill(spark):
    docs = spark.createDataFrame([("a", "x", "m"), ("b", "x", "m"), ("c", "x", "m"), ("d", None, "m")], "source_id string, body string, status string")
    h = ingest.hashed(docs, ["source_id", "body"], ["source_id", "body", "status"])
    stored = h.where("source_id <> 'c'").withColumn("embed_hash", F.when(F.col("source_id") != "a", F.col("embed_hash"))).withColumn("meta_hash", F.when(F.col("source_id") == "b", "old").otherwise(F.col("meta_hash")))
    assert {r.source_id: r.action for r in ingest.plan(h, stored).collect()} == {"a": "skip", "b": "refresh", "c": "embed", "d": "skip"}


def test_review(spark):
    ev = spark.createDataFrame([(1, "i", 1, "pending"), (2, "i", 2, "deleted"), (3, "j", 1, "suspected")], "id int, item string, at int, status string")
    for bad in ("bogus", None):
        with pytest.raises(Exception, match="no such status"):
            review.latest(ev.union(spark.createDataFrame([(4, "k", 1, bad)], ev.schema))).collect()
    with pytest.raises(ValueError):
        review.event(spark, "i", "bogus", "2026-01-01", 5)
    assert review.event(spark, "i", "approved", "2026-01-01 00:00:00", 5, "me").first().status == "approved"
    assert {r.item: r.status for r in review.latest(ev).collect()} == {"i": "deleted", "j": "suspected"}
    assert [tuple(r) for r in review.undone(ev).collect()] == [("i", "pending")]


def test_sources(spark, tmp_path):
    from lodestone.sources import registry, sinks

    for kind in ("issues", "prs", "comments"):
        (tmp_path / kind).mkdir()
    (tmp_path / "issues/1.json").write_text(json.dumps({"number": 1, "title": "T", "body": "B\u2028C", "labels": [{"name": "v0.2"}], "state": "open", "created_at": "2026-01-01T00:00:00Z"}))
    (tmp_path / "prs/2.json").write_text(json.dumps({"number": 2, "title": "P", "body": "", "labels": [], "state": "closed", "pull_request": {"merged": True, "merged_at": "2026-01-02T00:00:00Z"}}))
    (tmp_path / "comments/1.json").write_text(json.dumps([{"user": {"login": "me"}, "created_at": "t", "body": "hi"}]))
    (tmp_path / "md").mkdir()
    (tmp_path / "md/a.md").write_text("x\n# Head\n![i](http://x/y.png)")
    (tmp_path / "md/b.tables.json").write_text(json.dumps({"source": "man", "tables": [{"page": 1, "index": 0, "rows": [["a", "b|c"], ["E12345"]]}]}))
    made = registry.build_sources([{"type": "issues", "path": str(tmp_path), "repo": "o/r", "component": "engine"}, {"type": "markdown", "path": str(tmp_path / "md")}, {"type": "parsed_tables", "path": str(tmp_path / "md")}, {"type": "excel"}, {"type": "nope"}, {"type": "excel", "enabled": False}])
    docs = registry.collect(spark, made)
    got = {r.source_id: r for r in docs.collect()}
    assert set(got) == {"github:o-r:issue:1", "github:o-r:pr:2", "markdown:a", "tables:man"}
    assert got["github:o-r:issue:1"].body.endswith("### me (t):\nhi") and got["github:o-r:pr:2"].status == "merged" and got["markdown:a"].title == "Head"
    assert got["tables:man"].body == "| a | b\\|c |\n|---|---|\n| E12345 |  |"
    store = str(tmp_path / "store")
    sinks.overwrite(docs.where("source_id <> 'markdown:a'"), store)
    sinks.append(docs, store)
    sinks.append(docs, store)
    assert sinks.read(spark, store).count() == 4
    sinks.export_json(docs, str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == 4
    (tmp_path / "out/part-bad.txt").write_text("not json\n")
    assert sinks.read_json(spark, str(tmp_path / "out")).count() == 4


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from lodestone.streaming.ingest import run_available

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = run_available(spark, str(tmp_path / "in"), "event_id", ["event_id", "props"], ["event_id", "props", "value"])
    want = ingest.hashed(events, ["event_id", "props"], ["event_id", "props", "value"]).select("event_id", "embed_hash", "meta_hash")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Batches by stores that know nothing of each other, and one that runs twice."""
    from lodestone.streaming.ingest import Store

    rows = lambda *r: spark.createDataFrame(list(r), "id long, body string")
    take = lambda b, n: Store(spark, str(tmp_path / "s"), "id", 4).merge(b, n, "id", ["body"], ["id", "body"])
    read = lambda: {r.id: r.body for r in Store(spark, str(tmp_path / "s"), "id", 4).read().collect()}
    assert Store(spark, str(tmp_path / "s"), "id", 4).read() is None
    take(rows((1, "a"), (2, "b")), 0)
    take(rows((3, "c")), 1)
    assert read() == {1: "a", 2: "b", 3: "c"}
    take(rows((3, "d"), (4, "e")), 2)
    take(rows((3, "d"), (4, "e")), 2)
    assert read() == {1: "a", 2: "b", 3: "d", 4: "e"}
    take(rows((2, "z")).where("false"), 3)
    assert read() == {1: "a", 2: "b", 3: "d", 4: "e"}
