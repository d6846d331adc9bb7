"""Nearest rows of many vectors against all pairs, and searches that embed their queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import grams
from lodestone.operators import fulltext, vectors
from lodestone.plans import search


def cosine(a, b):
    if len(a) != len(b):
        return 0.0
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    return max(0.0, sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)))


@pytest.mark.parametrize("blocks", [(10**6, 10**6), (7, 3)])
def test_nearest_each(spark, blocks):
    r = random.Random(4)
    rows = [(f"c{i}", [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(r.choice([3, 3, 3, 2]))]) for i in range(60)]
    rows += [("zero", [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), ("none", None)]
    asked = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(r.choice([3, 2, 4]))]) for i in range(12)] + [(99, None), (None, [1.0, 0.0, 0.0])]
    got = vectors.nearest_each(
        spark.createDataFrame([(*x, 1, 2) for x in rows], "chunk_id string, embedding array<float>, rb int, q int"), spark.createDataFrame([(*x, 3) for x in asked], "query_id long, vector array<double>, id int"), 5, row_block=blocks[0], query_block=blocks[1]
    ).collect()
    want = []
    for q, v in asked:
        if q is not None and v is not None:
            best = sorted(((-round(cosine(v, x), 9), c) for c, x in rows if c is not None and x is not None))[:5]
            want += [(q, c, round(-s, 6), n + 1) for n, (s, c) in enumerate(best)]
    assert sorted((x.query_id, x.id, round(x.sim, 6), x.place) for x in got) == sorted(want)


def test_nearest_each_of_nothing(spark):
    rows = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert vectors.nearest_each(rows.limit(0), asked).count() == 0 == vectors.nearest_each(rows, asked.limit(0)).count()
    assert [tuple(x) for x in vectors.nearest_each(rows, asked, 50).collect()] == [(1, "a", 1.0, 1)]


def test_grams(spark):
    texts = ["ab\U0001f600cd é", "", "a", "ab\n", None, "x" * 5000]
    for n in (1, 2, 4):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(grams(F.col("t"), n).alias("g")).collect()
        assert [x.g for x in got] == [None if t is None else [t[i : i + n] for i in range(len(t) - n + 1)] for t in texts]


def by_subject(texts):
    if any("broken" in t for t in texts):
        raise OSError("no answer")
    return [[float("memory" in t), float("timeout" in t), 0.1] for t in texts]


def test_queries_are_embedded_or_answered_by_text_alone(spark):
    said = {"d1": "out of memory", "d2": "a timeout of the engine", "d3": "memory and timeout", "d4": "something else"}
    chunks = spark.createDataFrame([(f"{d}#0", d, t) for d, t in said.items()], "chunk_id string, doc_id string, text string")
    docs = spark.createDataFrame([(d, "engine" if d < "d3" else "other", "open", "2024-01-01", "0.1.0") for d in said], "doc_id string, component string, status string, created_at string, version_min string")
    docs = docs.withColumns({"version_max": F.lit(None).cast("string"), "resolved_at": F.lit(None).cast("string"), "source_type": F.lit("github_issue"), "kind": F.lit(None).cast("string"), "verification": F.lit(None).cast("string")})
    held = chunks.select("chunk_id", F.array(F.contains("text", F.lit("memory")).cast("double"), F.contains("text", F.lit("timeout")).cast("double"), F.lit(0.1)).alias("embedding"))
    texts = spark.createDataFrame([("a", "engine:0.2.0 memory"), ("b", "broken timeout"), ("c", "timeout"), ("d", "engine:0.3.0 "), ("e", "   ")], "query_id string, text string").repartition(5)
    run = lambda **o: search.component_search(chunks, docs, fulltext.postings(chunks), fulltext.token_lengths(chunks), texts, F.lit("2024-02-01").cast("timestamp"), F.lit("9.9.9"), recall=2, **o).collect()
    got = run(vectors_of=held, provider=by_subject)
    src = {(x.query_id, x.doc_id): x.src for x in got}
    assert src["a", "d1"] == "both" and src["c", "d2"] == "both" and {q for q, _ in src} >= {"a", "c", "d"}
    assert {s for (q, _), s in src.items() if q == "b"} <= {"fts"} and {s for (q, _), s in src.items() if q == "e"} == {"vector"}
    assert {x.version_ref for x in got if x.query_id == "a" and x.doc_id in ("d1", "d2")} == {"0.2.0"}
    alone = {(x.query_id, x.doc_id): (x.src, round(x.final, 9)) for x in run()}
    down = {(x.query_id, x.doc_id): (x.src, round(x.final, 9)) for x in run(vectors_of=held, provider=lambda texts: 1 / 0)}
    assert alone == down and {s for s, _ in alone.values()} == {"fts"}
    with pytest.raises(ValueError):
        run(vectors_of=held, vector_hits=held)
