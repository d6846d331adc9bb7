"""Quality rules: counts over whole texts, two fixed rules, and boosted trees over the counts for the rest.

The trees are trained on the driver from a sample of the labelled rows, ``sample`` at most, taken by a hash of the id;
everything else is over every row. Some features may only lower the score (symbols, repeated lines and words, capitals
and figures), one may only raise it (the share of a language's commonest words). Scoring needs one row at a time.

Defined cases: a null text counts as empty; a text without words fails the fixed rules. Without labels of both kinds the
trees have no say, and ``kept`` is what the fixed rules leave. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import Forest, train
from .common import id_text, released, text_chunks

#: Words that are common in the languages of the corpus.
COMMON = frozenset(b"the of and to in is that for it as was with be by on de la le et les des un une que en el los las y del der die und das den von zu mit ist".split())
#: Name and direction of each feature.
FEATURES = (("log_words", 0), ("word_length", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1), ("digit_share", -1), ("letter_share", 0), ("unique_share", 0), ("line_words", 0), ("common_share", 1), ("bar_share", -1), ("mark_share", -1), ("longest_word", 0), ("end_share", 0))
MONOTONE = np.array([d for _, d in FEATURES])
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
WINDOW = 5


def repeat_words(ids: np.ndarray, n_ids: int, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more; ``ids`` are numbers below ``n_ids``. Exact, without hashing."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, size = ids[:n].astype(np.int64), n_ids
    for k in range(1, window):
        if size >= 2**62 // max(n_ids, 1):
            _, key = np.unique(key, return_inverse=True)
            size = n
        key, size = key * n_ids + ids[k : k + n], size * n_ids
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int32)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(data: bytes) -> tuple[list[int], list[float]]:
    """The counts and the features of a text in UTF-8."""
    words = data.split()
    known = dict.fromkeys(words)
    known = dict(zip(known, range(len(known)), strict=True))
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    repeated = repeat_words(ids, len(known))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = int(c.sum() - c[128:192].sum())
    chars = points - int(c[9:14].sum() + c[32])
    symbols = int(c[SYMBOLS].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    n, per = len(words), max(chars, 1)
    upper, digits, letters = int(c[65:91].sum()), int(c[48:58].sum()), int(c[65:91].sum() + c[97:123].sum() + c[194:].sum())
    common = sum(map(COMMON.__contains__, words)) if n else 0
    lengths = list(map(len, known)) or [0]
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    w, k = max(n, 1), max(len(lines), 1)
    features = [np.log1p(n), chars / w, symbols / per, dup / k, repeated / w, upper / per, digits / per, letters / per, len(known) / w, n / k, common / w, int(c[124]) / per, int(c[33]) / per, min(max(lengths), 200), ends / k]
    return [n, chars, symbols, dup, repeated], features


def _measured(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in text_chunks(batch):
            got = [measure(x or b"") for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield part.column(0).to_pylist(), np.array([x for x, _ in got], np.int64).reshape(-1, 5), np.array([x for _, x in got], float).reshape(-1, len(FEATURES))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest | None:
    """Trees from at most ``sample`` labelled rows (those whose ids hash lowest); None without both kinds of label."""
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches):
        for batch in batches:
            for ids, _, x in _measured([batch.select(["doc_id", "text"])]):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    measured = id_text(docs, id_col, text_col).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(released(run), "doc_id bigint, x array<double>")
    label = {r["doc_id"]: r["label"] for r in chosen.collect()}
    rows = sorted((r["doc_id"], r["x"]) for r in measured.dropDuplicates(["doc_id"]).collect())
    y = np.array([label[i] for i, _ in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    return train(np.array([x for _, x in rows]), y, MONOTONE)


def quality_rules(docs: DataFrame, forest: Forest | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, fixed rules and verdict of every row; ``score`` is the trees' (1 where there are none)."""

    def run(batches):
        for ids, counts, x in _measured(batches):
            n, repeated = counts[:, 0], counts[:, 4]
            failed = (n < 10) | (100 * repeated > 20 * n)
            score = forest.score(x) if forest is not None and len(x) else np.ones(len(x))
            columns = [pa.array(ids, pa.int64()), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(released(run), SCHEMA)
