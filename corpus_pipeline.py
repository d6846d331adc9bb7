"""A corpus pipeline of five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, decontaminate, jaccard_join, secret_scan, sentencepiece_codec, toxicity
from lodestone.llm.queries import PIECES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go.

    Null and empty texts have score 0 and stay; repeated rows are judged each; without labels of both kinds all stay. An
    empty table gives an empty one. All columns stay.
    """
    return toxicity.drop_toxic(docs, toxicity.train_toxicity(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id.

    Near copies share 0.8 of their five-word shingles. Null and empty texts and rows with a null id stay; of rows with one
    id and one text one stays. All columns stay, whatever their names.
    """
    return jaccard_join.drop_near_copies(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go.

    Null and empty texts stay, and null or empty items match nothing; with an empty benchmark all stay. All columns stay.
    """
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    A null text stays null; n_chars follows the new text; other columns stay as they are.
    """
    return secret_scan.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: a row each, repeated ones too. A null text has null ids, an empty one none."""
    return sentencepiece_codec.sentencepiece_encode(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: SQL can't express the trained network, the tiling or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them the rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
