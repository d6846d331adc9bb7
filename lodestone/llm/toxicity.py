"""Toxicity of whole texts: a bidirectional gated network over all overlapping windows of words.

A text's score is that of its worst window. The labels say only that a text is toxic, not where: training takes the
windows that the network itself finds worst, again in each epoch, beginning with those whose words and pieces stand out
most in toxic texts. It uses at most ``sample`` labelled texts of either kind, by a hash of the id, of at most
``sample_chars`` characters; ids with crc32 mod 4 = 2 are held out. Scoring covers every window of every text, one row
at a time and without a shuffle. Labels, language, source and id are no inputs.

Defined cases: a text without words, or null, has score 0; without labels of both kinds every score is 0. Repeated rows
are scored each; null ids are not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, released, small_batches, text_chunks
from .gated_network import BITS, WORD, Adam, Network, Tokens, joined, many_tokens, sigmoid, tokens, windows

WIDTH, STEP = 48, 32
#: Bytes of text that are scored at once.
CHUNK = 1 << 18
#: Share of words hidden in training, and how fast unused vectors fade.
HIDDEN_WORDS, DECAY = 0.4, 0.5
#: Share of the sample that isn't trained on but fits the scores.
ASIDE = 0.2
HELD_OUT, FOLDS, LEAST_SCORE = 2, 4, 0.3
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def fold(column):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS))


def _stand_out(parts: list[Tokens], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket of words and of pieces: log odds that a text that holds it is toxic, less where few do."""
    counts = np.zeros((2, 2, 1 << BITS))
    at = 0
    for t in parts:
        n = len(t.rows) - 1
        text = np.repeat(np.arange(at, at + n), np.diff(t.rows))
        for kind, (bucket, owner) in enumerate(((t.word, text), (t.piece, np.repeat(text, np.diff(t.first))))):
            pair = np.unique(owner << BITS | bucket)
            of, b = pair >> BITS, pair & ((1 << BITS) - 1)
            for v in (0, 1):
                counts[kind, v] += np.bincount(b[y[of] == v], minlength=1 << BITS)
        at += n
    out = []
    for no, yes in counts:
        odds = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / ((1 - y).sum() + 1))
        seen = yes + no
        out.append(np.where(seen >= 3, odds * seen / (seen + 10), 0).astype(np.float32))
    return out[0], out[1]


def train_network(texts: list[bytes], labels: list[int], share: float, epochs: int = 6, batch: int = 128, steps: int = 300, rate: float = 0.01, seed: int = 7) -> Network | None:
    """``share`` is the portion of toxic texts outside the sample; scores are fitted to it. None without both kinds."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    net, random = Network(seed), np.random.default_rng(seed)
    parts = list(many_tokens(texts))
    word, piece = _stand_out(parts, y)
    t = joined(parts)
    del parts
    net.p["word"][:, 0], net.p["piece"][:, 0] = word / 2, piece / 2
    start, size, owner = windows(t.rows, WIDTH, STEP)
    at = np.concatenate([[0], np.cumsum(np.maximum(word[t.word], 0) + np.maximum(np.add.reduceat(piece[t.piece], t.first[:-1]) * t.share[:, 0], 0))])
    worst = at[start + size] - at[start]
    optimiser = Adam(net.p, rate)
    aside = random.random(len(y)) < ASIDE  # for fitting the scores
    if min(y[aside].sum(), (1 - y[aside]).sum()) < 5:
        aside[:] = False
    epochs = max(epochs, min(40, -(-steps * batch // (2 * len(y)))))  # few texts need more rounds
    for epoch in range(epochs):
        if epoch:
            worst = _window_logits(net, t, start, size)
        order = np.lexsort((-worst, owner))
        top = np.zeros(len(order), np.int64)
        top[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        pick = np.flatnonzero((top == 0) | ((y[owner] == 0) & (random.random(len(owner)) < min(1.0, len(y) / len(owner)))))
        pick = random.permutation(pick[~aside[owner[pick]]])
        heavy = np.where(y[owner[pick]] == 1, (y[owner[pick]] == 0).sum() / max((y[owner[pick]] == 1).sum(), 1), 1.0).clip(0.2, 5).astype(np.float32)
        optimiser.rate = rate * (1 - epoch / (epochs + 1))
        for i in range(0, len(pick), batch):
            b, keep = pick[i : i + batch], {}
            some, at = net.part(t, start[b], size[b])
            x = net.inputs(some)
            # words are left out at random, so that pieces must do too, and what few texts hold isn't learned by heart
            hidden = random.random(len(x)) < HIDDEN_WORDS
            x[hidden, :WORD] = 0
            logit = net.forward(x, at, size[b], WIDTH, keep)
            g, dx = net.gradients(x, keep, ((sigmoid(logit) - y[owner[b]]) * heavy[i : i + batch] / len(b)).astype(np.float32))
            dx[hidden, :WORD] = 0
            optimiser.update(g | net.table_gradients(some, dx))
            for table in ("word", "piece"):
                net.p[table] *= 1 - DECAY * optimiser.rate
    best = np.full(len(y), -20.0)
    np.maximum.at(best, owner, _window_logits(net, t, start, size))
    own = aside if aside.any() else np.ones(len(y), bool)
    net.scale, net.shift = _fitted(best[own], y[own], share)
    return net


def _fitted(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic regression of one variable by Newton steps, rows weighted as if ``share`` of them were toxic."""
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    target = np.where(y == 1, 0.97, 0.01)  # some labels are wrong
    p, m = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(200):
        s = sigmoid((m @ p).clip(-30, 30))
        h = (m * (w * s * (1 - s))[:, None]).T @ m + 1e-3 * np.eye(2)
        p = p - np.linalg.solve(h, m.T @ (w * (s - target)) + 1e-3 * (p - [1.0, 0.0])).clip(-0.1, 0.1)
    return max(float(p[0]), 0.05), float(p[1])


def _logits(net: Network, x: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 8192) -> np.ndarray:
    """Full windows together, others together: only the latter need a mask."""
    out = np.zeros(len(start), np.float32)
    for group in (np.flatnonzero(size == WIDTH), np.flatnonzero(size < WIDTH)):
        for i in range(0, len(group), most):
            b = group[i : i + most]
            out[b] = net.forward(x, start[b], size[b], WIDTH)
    return out


def _window_logits(net: Network, t: Tokens, start: np.ndarray, size: np.ndarray, most: int = 2048) -> np.ndarray:
    """The same of a large sample, with the inputs of some windows at a time."""
    out = np.zeros(len(start), np.float32)
    for i in range(0, len(start), most):
        some, at = net.part(t, start[i : i + most], size[i : i + most])
        out[i : i + most] = _logits(net, net.inputs(some), at, size[i : i + most])
    return out


def scores(net: Network | None, texts: list[bytes]) -> np.ndarray:
    """The score of each text."""
    worst = np.full(len(texts), -np.inf)
    if net is not None:
        t = tokens(texts)
        start, size, owner = windows(t.rows, WIDTH, STEP)
        if len(start):
            np.maximum.at(worst, owner, _logits(net, net.inputs(t), start, size))
    known = np.isfinite(worst)
    return np.where(known, sigmoid((net.scale if net else 1) * np.where(known, worst, 0) + (net.shift if net else 0)), 0.0)


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 2500, sample_chars: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").where(fold(F.col("doc_id")) != HELD_OUT)
    kinds = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    short = id_text(docs, id_col, text_col).where(F.length("text") <= sample_chars)
    pick = lambda v: known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(1).union(pick(0)).dropDuplicates(["doc_id"])
    rows = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").collect()
    rows = sorted({r["doc_id"]: r for r in sorted(rows)}.values())
    return train_network([r["text"].encode() for r in rows], [r["label"] for r in rows], kinds.get(1, 0) / max(sum(kinds.values()), 1))


def toxicity(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, CHUNK):
                s = scores(shared.value, [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(s), pa.array((s >= LEAST_SCORE).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return id_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))).mapInArrow(released(run), SCHEMA)


def drop_toxic(docs: DataFrame, net: Network | None, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is under ``least``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            good = [s < least for part in text_chunks(batch.select([text_col]), CHUNK) for s in scores(shared.value, [x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()])]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
