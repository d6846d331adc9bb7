"""The pipeline's stages one after another, over rows of every kind."""

from pyspark.sql import functions as F

import corpus_pipeline

CLASHES = ("_gone", "_slot", "rep", "tile", "spans", "score")


def test_stages_in_turn(spark, sf_dir):
    """Each stage works on what the one before kept; what goes and what stays is known beforehand."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    clean = [" ".join(f"plain{i}x{j}" for j in range(40)) for i in range(4)]
    rows = [(1, clean[0]), (2, clean[0] + " tail"), (3, clean[1]), (3, clean[1]), (4, item), (5, None), (6, ""), (None, clean[2]), (7, clean[3] + " token=abcdefgh12")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in CLASHES})
    start = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == start, name
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept == {(1, clean[0]), (3, clean[1]), (5, None), (6, ""), (None, clean[2]), (7, clean[3] + " [SECRET]")} and docs.count() == 6
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(out) == 6 and all(r.parity and r.round_trip for r in out)


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
