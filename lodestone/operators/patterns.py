"""Which of many patterns each text holds, in any script: an automaton over the patterns, sent to the texts in bounded parts."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of patterns that are sent at a time; a set that is larger is cut by a hash, and each part passes over the texts.
PART_BYTES = 8 << 20


def contained(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text", pattern_col: str = "key", part_bytes: int = PART_BYTES) -> DataFrame:
    """id, key of the different patterns that stand anywhere in each text, exactly as they are written.

    Texts are read once for each part of the patterns and stay in their partitions: nothing but the hits is sent on. Null or
    empty patterns, and null texts, meet nothing. Of equal ids each row gives its own hits.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    kind = dict(rows.dtypes)["id"]
    out = None
    for some in _in_parts(patterns, pattern_col, part_bytes):
        found = rows.mapInArrow(_search(texts.sparkSession.sparkContext.broadcast(some)), f"id {kind}, key string")
        out = found if out is None else out.unionByName(found)
    return out


def counted(texts: DataFrame, patterns: DataFrame, text_col: str = "text", pattern_col: str = "key", part_bytes: int = PART_BYTES) -> DataFrame:
    """The other columns of texts, key and n (integer): how often each of the different patterns stands there, overlaps included.

    Texts are read as by :func:`contained`; hits of a text are counted where it lies.
    """
    kept = [f for f in texts.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("key", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = texts.select(*[f.name for f in kept], text_col).where(F.col(text_col) != "")
    out = None
    for some in _in_parts(patterns, pattern_col, part_bytes):
        found = rows.mapInArrow(_count(texts.sparkSession.sparkContext.broadcast(some)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _in_parts(patterns: DataFrame, pattern_col: str, part_bytes: int):
    """The different patterns as lists of bounded size; one list, though empty, at least."""
    keys = patterns.select(F.col(pattern_col).cast("string").alias("key")).where("key <> ''").distinct()
    size = keys.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    for k in range(parts):
        yield [r[0] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).collect()]


def automaton(words: list[str]):
    """Finds all words in one pass over a text, as their numbers; None of no words."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for number, word in enumerate(words):
        machine.add_word(word, number)
    if not words:
        return None
    machine.make_automaton()
    return machine


def hits(machine, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
    """Numbers of texts and of words in them, and how often they stand there."""
    at, which, times = [], [], []
    for i, text in enumerate(texts):
        found = Counter(number for _, number in machine.iter(text)) if text else {}
        at += [i] * len(found)
        which += found.keys()
        times += found.values()
    return at, which, times


def _count(shared):
    """A function of Arrow batches whose last column is a text to hits."""

    def run(batches):
        words, machine = pa.array(shared.value, pa.string()), automaton(shared.value)
        for batch in batches if machine else ():
            at, which, times = hits(machine, batch.column(batch.num_columns - 1).to_pylist())
            rows = pa.array(at, pa.int64())
            columns = [c.take(rows) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, words.take(pa.array(which, pa.int64())), pa.array(times, pa.int32())], names=[*batch.schema.names[:-1], "key", "n"])

    return run


def _search(shared):
    """A function of Arrow batches (id, text) to hits (id, key)."""

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in shared.value:
            machine.add_word(word, word)
        if not shared.value:
            return
        machine.make_automaton()
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(batch.column(1)):
                held = {word for _, word in machine.iter(text.as_py())}
                at += [i] * len(held)
                keys += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string())], names=["id", "key"])

    return run
