"""Recorded pages as a data source, in batch and as a stream, and the stored code index."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing, symbols
from lodestone.operators import code
from lodestone.operators.code_index import CodeIndex
from lodestone.plans import build
from lodestone.sources import pages, registry


def item(n, title="t", **more):
    return {"number": n, "title": title, "body": f"body {n}", "labels": [{"name": "bug"}], "state": "open", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "html_url": f"u/{n}", **more}


def put(root, feed, cursor, items, then=None):
    folder = root / feed
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{cursor}.json").write_text(json.dumps({"items": items, "next": then}))


def test_pages_give_documents(spark, tmp_path):
    put(tmp_path, "issues", "start", [item(1), item(2, "old")], "c2")
    put(tmp_path, "issues", "c2", [item(2, "new", updated_at="2024-02-01T00:00:00Z"), {"title": "no number"}], "later")
    put(tmp_path, "own-prs", "start", [item(3, "fix", state="closed", pull_request={"merged": True, "merged_at": "2024-03-01T00:00:00Z"})])
    put(tmp_path, "empty", "start", [])
    assert sorted((r.feed, r.cursor) for r in pages.recorded(spark, str(tmp_path)).collect()) == [("issues", "c2")] * 2 + [("issues", "start")] * 2 + [("own-prs", "start")]
    source = registry.build_sources([{"type": "recorded_pages", "path": str(tmp_path), "repo": "o/r", "component": "engine"}])
    docs = {r.source_id: r for r in registry.collect(spark, source).collect()}
    assert set(docs) == {"github:o-r:issue:1", "github:o-r:issue:2", "github:o-r:pr:3"} and docs["github:o-r:issue:2"].title == "new" and docs["github:o-r:pr:3"].source_type == "github_pr"


def test_a_cursor_that_does_not_advance_is_refused(spark, tmp_path):
    put(tmp_path, "issues", "start", [item(1)], "a")
    put(tmp_path, "issues", "a", [item(2)], "start")
    with pytest.raises(Exception, match="does not advance"):
        pages.recorded(spark, str(tmp_path)).count()


def test_a_stopped_stream_resumes_at_its_cursor(spark, tmp_path):
    """What was taken in is not read again, whether the feed's end named its next page or not."""
    root, out, mark = tmp_path / "feeds", str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        query = pages.recorded(spark, str(root), stream=True).withColumn("number", F.get_json_object("item", "$.number").cast("int")).writeStream.format("parquet").option("checkpointLocation", mark).option("path", out)
        query.trigger(once=True).start().awaitTermination()
        return sorted((r.feed, r.number) for r in spark.read.parquet(out).collect())

    put(root, "a", "start", [item(1)], "p2")
    put(root, "b", "start", [item(10)])
    assert run() == [("a", 1), ("b", 10)]
    put(root, "a", "p2", [item(2), item(3)])
    put(root, "b", "start", [item(10)], "p2")
    put(root, "b", "p2", [item(11)])
    put(root, "c", "start", [item(20)])
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("b", 10), ("b", 11), ("c", 20)]
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("b", 10), ("b", 11), ("c", 20)]


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "repo string, version string, path string, content string")


def test_code_index(spark, tmp_path):
    index = CodeIndex(spark, str(tmp_path / "ix"))
    first = sources(spark, ("r", "0.10", "src/a.py", "def Alpha():\n    pass\nclass Beta:\n  x = alpha"), ("r", "0.1", "src/b.cpp", "void gamma(int a) {\n}"), ("r", "0.1", "tests/t.py", "def left_out():"), ("q", "0.1", "src/a.py", "def alpha():"), (None, "1", "a.py", "def x():"))
    index.add(first)
    files = lambda: {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/ix/*/*/*/*.parquet")}
    before = files()
    assert {(r.repo, r.version, r.files) for r in index.versions().collect()} == {("r", "0.10", 1), ("r", "0.1", 1), ("q", "0.1", 1)}
    assert [(r.version, r.path, r.line, r.text, r.stage) for r in index.search("ALPHA", "r").collect()] == [("0.10", "src/a.py", 1, "def Alpha():", "symbol")]
    assert [(r.line, r.stage) for r in index.search("x = al", "r").collect()] == [(4, "line")] and index.search("left_out", "r").isEmpty()
    index.add(sources(spark, ("r", "0.2", "src/a.py", "def alpha():")))
    assert {p: t for p, t in files().items() if p in before} == before and {p.split("version=")[1].split("/")[0] for p in set(files()) - set(before)} == {"0.2"}
    plan = index.symbols("r", ["0.2"]).where("symbol = 'alpha'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan and "PushedFilters: [" in plan and "EqualTo(symbol,alpha)" in plan
    index.add(sources(spark, ("r", "0.10", "docs/x.md", "nothing to index")))
    assert index.symbols("r", ["0.10"]).isEmpty() and {(r.version, r.files) for r in index.versions("r").collect()} == {("0.1", 1), ("0.10", 0), ("0.2", 1)}


def test_code_index_equals_the_plain_search(spark, tmp_path):
    rows = [("r", f"{v}", f"src/f{i}.py", f"class C{i}:\n  def run_{i % 3}(self):\n    return word{v}") for v in range(3) for i in range(6)]
    index = CodeIndex(spark, str(tmp_path / "ix"))
    index.add(sources(spark, *rows))
    plain = sources(spark, *rows)
    for name, per in (("run_1", False), ("word2", False), ("return", True), ("none", False)):
        want = code.two_stage(symbols.code_symbols(plain), symbols.source_lines(plain), name, 7, per).collect()
        assert index.search(name, "r", (), 7, per).collect() == want


def test_a_symbol_table_is_made_where_none_is_saved(spark, tmp_path):
    trees = spark.createDataFrame([("v1", "src/a.py", "enable_fast_path aclnnScatter init"), ("v2", "src/a.py", "npuGather aclnnScatter"), ("v2", "tests/t.py", "enable_left_out"), ("v1", "src/a.txt", "enable_text")], "version string, path string, content string")
    issues = spark.createDataFrame([("i", "[Bug] Qwen3-8B on CANN 8.1", "errStr: vector core timeout\n" * 3)], "source_id string, title string, body string")
    saved = str(tmp_path / "symbols")
    made = build.symbol_table(spark, saved, trees, issues)
    got = {r.key: (r.kind, list(r.versions)) for r in made.collect()}
    assert got == {"enable_fast_path": ("feature", ["v1"]), "aclnnscatter": ("kernel", ["v1", "v2"]), "npugather": ("kernel", ["v2"]), "qwen3-8b": ("model", ["kb"]), "cann 8.1": ("version", ["kb"])} | {k: v for k, v in got.items() if v[0] == "phrase"}
    assert any(k == "vector core timeout" for k in got)
    os.makedirs(saved)
    (tmp_path / "symbols" / "broken.json").write_text("no table")
    assert {r.key for r in build.symbol_table(spark, saved, trees, issues).collect()} == set(got)
    registry.write_symbol_table(made.where("kind = 'kernel'"), str(tmp_path / "kept"))
    assert {r.key for r in build.symbol_table(spark, str(tmp_path / "kept"), trees, issues).collect()} == {"aclnnscatter", "npugather"}


def test_lines(spark):
    rows = spark.createDataFrame([("v1", "a.py", 3, "  def x(): "), (None, "b", 1, None)], "version string, path string, line int, text string")
    assert [r[0] for r in rows.select(parsing.code_line(*map(F.col, rows.columns))).collect()] == ["[v1] a.py:3: def x():", "[-] b:1: "]
    tags = spark.createDataFrame([("v1", "release", "exact", "2024-01-02"), ("v2", "unknown", "none", None), ("v3", "rc", "plain", None)], "tag string, kind string, match string, date string")
    assert [r[0] for r in tags.select(parsing.version_line(F.col("tag"), F.col("kind"), F.col("match"), F.col("date").cast("timestamp"))).collect()] == ["v1 = release (2024-01-02)", "v2: not in the calendar (unknown)", "v3 = rc (-)"]
    chains = spark.createDataFrame([("i", "p", "v1", "2024-01-02"), ("i", "q", None, None)], "issue string, request string, tag string, date string")
    assert [r[0] for r in chains.select(parsing.chain_line(F.col("issue"), F.col("request"), F.col("tag"), F.col("date").cast("timestamp"))).collect()] == ["i <- p in v1 (2024-01-02)", "i <- q not released"]
